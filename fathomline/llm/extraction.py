"""Main text of web pages by the maximum-scoring subsequence, with weights learned from labelled pages.

A page is a sequence of words and tags. Words score 0 to 1 and tags below 0; one linear scan finds the contiguous run with
the greatest sum (the first of equal ones), widened to whole blocks. Its words that score above 0 are the main text.

All weights come from labelled pages. A tag's is the lower, the more often it stands outside main text. A logistic
model tells from an element's features (its name, each class, id and role, their parts, what it holds, its share of the
page's words and of linked words) whether it holds main text, given that the element around it does. The least likely
element around a word gives the word's weight, and one that is unlikely adds to its start tag's.
Pages are labelled by the attributes ``data-main`` of elements that hold it and ``data-aside`` of those in them that don't;
``labelled_pages`` makes such pages by rule from many layouts, 2,000 of them unless told otherwise.

Scripts, styles and other elements whose content is no text never count, and comments in the markup neither. Unclosed
elements end with their parent, stray end tags are ignored, and a page that breaks off is read as far as it goes.
Character references are decoded. White space in a block becomes one space; blocks are joined by one line feed. Null html
and pages without words give an empty text; very long pages and attributes are read whole; repeated rows and null ids are
kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, whole

#: A comment, declaration, tag (quoted attribute values may hold ">"), or a tag that the page's end cuts off.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:\-]*)([^>]*)(?:>|\Z)", re.S)
#: Elements whose content is no text, block elements, elements without content, and ones that their like ends. Fixed values.
RAW = set("script style template iframe svg head title".split())
BLOCKS = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDED_BY_LIKE = set("p li dt dd option td th tr".split())
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Names that tell of the element which holds them, and how deep elements lie: deeper ones are siblings, as in browsers.
TOLD, DEEPEST = set("article main h1 p input textarea nav footer aside".split()), 400
LABEL = re.compile(r"(?:^|\s)data-(main|aside)(?:[\s=]|$)")


class Node:
    """An element: its name, attributes and parent, its words and those in links, its texts and the names of what it holds."""

    __slots__ = ("attributes", "depth", "holds", "in_link", "linked", "name", "parent", "score", "texts", "within", "words")

    def __init__(self, name: str, attributes: str, parent: Node | None):
        self.name, self.attributes, self.parent = name, attributes, parent
        self.words = self.linked = self.texts = 0
        self.holds: set[str] = set()
        self.score: float | None = None
        self.depth = parent.depth + 1 if parent else 0
        self.within = parent is not None and (parent.within or parent.name in ("article", "main"))
        self.in_link = name in ("a", "button") or (parent is not None and parent.in_link and name not in BLOCKS)


def above(node: Node | None, name: str) -> Node | None:
    """The nearest element of that name from node up; an inline one without leaving its block."""
    while node is not None and node.name != name:
        if name not in BLOCKS and node.name in BLOCKS:
            return None
        node = node.parent
    return node


def sequence(page: str) -> tuple[list[tuple[str, str, Node]], list[Node]]:
    """(tag or "", text, element) in page order, and the elements; a start tag's element is its own, where it has one, else the one around it."""
    out: list[tuple[str, str, Node]] = []
    root = here = Node("", "", None)
    nodes, flat = [root], 0
    at, end = 0, len(page)
    while at < end:
        found = MARKUP.search(page, at)
        text = page[at : found.start() if found else end]
        if text:
            out.append(("", html.unescape(text), here))
        if not found:
            break
        at = found.end()
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            if flat and name not in VOID:
                flat -= 1
            elif (own := above(here, name)) is not None:
                here = own.parent or root
            out.append(("/" + name, "", here))
        elif name in RAW:
            last = raw_end(name).search(page, at)
            if name != "head" or last:
                at = end if not last else last.start() if last[0].lower().startswith("<body") else last.end()
            out.append((name, "", here))
        else:
            if name in ENDED_BY_LIKE and (own := open_like(here, name)) is not None:
                here = own.parent or root  # its end tag may be left out
            if name not in VOID and here.depth < DEEPEST:
                here = Node(name, attributes or "", here)
                nodes.append(here)
            elif name not in VOID:
                flat += 1
            out.append((name, "", here))
    return out, nodes


def open_like(node: Node, name: str) -> Node | None:
    """The element of that name which a start tag ends: nothing but inline elements are between."""
    while node.name != name:
        if node.name in BLOCKS or node.parent is None:
            return None
        node = node.parent
    return node


@cache
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>" if name != "head" else r"</head\s*>|<body[\s>]", re.I)


def measured(items: list[tuple[str, str, Node]], nodes: list[Node]) -> int:
    """Fills the counts of the elements (parents come before what they hold); the page's words."""
    for tag, text, node in items:
        if not tag:
            if n := len(text.split()):
                node.words += n
                node.texts += 1
                node.linked += n * node.in_link
        elif tag in TOLD:
            (node.parent if node.name == tag and node.parent else node).holds.add(tag)
    for node in reversed(nodes[1:]):
        up = node.parent
        up.words, up.texts, up.linked = up.words + node.words, up.texts + node.texts, up.linked + node.linked
        up.holds |= node.holds
    return max(1, nodes[0].words)


def is_judged(node: Node) -> bool:
    """Whether the model is asked: not for the page itself, nor for inline elements that are not marked in any way."""
    return node.name not in ("", "html", "body") and (node.name in BLOCKS or bool(ATTRIBUTE.search(node.attributes) or HIDDEN.search(node.attributes)))


def features(node: Node, total: int) -> list[str]:
    """What the model sees of an element on a page of ``total`` words."""
    name = node.name
    out = [f"tag {name}"]
    for kind, *values in ATTRIBUTE.findall(node.attributes) if node.attributes else ():
        for value in set("".join(values).split()):
            out.append(f"{kind.lower()} {value.lower()}")
            out += [f"part {x.lower()}" for x in set(PARTS.findall(value))]
    if node.attributes and HIDDEN.search(node.attributes):
        out.append("hidden")
    share, linked, length = node.words / total, node.linked / node.words, node.words / node.texts
    out.append(f"share {0 if share < 0.1 else 1 if share < 0.35 else 2 if share < 0.6 else 3 if share < 0.85 else 4}")
    out.append(f"linked {0 if not linked else 1 if linked < 0.1 else 2 if linked < 0.4 else 3 if linked < 0.8 else 4}")
    out.append(f"{name} {out[-2]}")
    out.append(f"run {min(6, int(math.log2(length)))}")
    out.append(f"words {min(9, int(math.log2(node.words)))}")
    out += [f"holds {x}" for x in sorted(node.holds)]
    if node.within:
        out += ["within", f"within {name}"]
    return out


class Model:
    """Weights of features (for elements) and of tags."""

    def __init__(self, weights: dict[str, float], tags: dict[str, float]):
        self.weights, self.tags = weights, tags

    def of(self, node: Node, total: int) -> float:
        """The score of an element's own words: the least of it and the elements around it, in -1 .. 1."""
        if node.score is None:
            own = 1.0
            if node.words and is_judged(node):
                own = sum(self.weights.get(x, 0.0) for x in features(node, total)) + self.weights.get("", 0.0)
                own = math.tanh(own / 2)
            node.score = min(own, self.of(node.parent, total) if node.parent is not None else 1.0)
        return node.score

    def scored(self, items: list[tuple[str, str, Node]], nodes: list[Node]) -> list[float]:
        total = measured(items, nodes)
        for x in nodes:
            self.of(x, total)
        other, out = self.tags["*"], []
        for tag, text, node in items:
            if not tag:  # a text counts as two words more than it has, so short headings are held
                n = len(text.split())
                out.append((n + 2) * max(0.0, self.of(node, total)) if n else 0.0)
            else:
                out.append(self.tags.get(tag.lstrip("/"), other) + (0.5 * min(0.0, self.of(node, total)) if node.name == tag else 0.0))
        return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last place of the contiguous run with the greatest sum, in one scan; (0, -1) if none is positive."""
    best, run, start, found = 0.0, 0.0, 0, (0, -1)
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, found = run, (start, i)
    return found


def main_text(page: str, model: Model) -> str:
    items, nodes = sequence(page)
    scores = model.scored(items, nodes)
    first, last = best_run(scores)
    breaks = [tag.lstrip("/") in BLOCKS for tag, _, _ in items]
    while 0 < first <= last and not breaks[first - 1]:  # to the ends of the blocks
        first -= 1
    while first <= last < len(items) - 1 and not breaks[last + 1]:
        last += 1
    blocks: list[str] = []
    held: list[str] = []
    for i in range(first, last + 1):
        tag, text, node = items[i]
        if breaks[i]:
            blocks.append("".join(held))
            held = []
        elif tag == "br":
            held.append(" ")
        elif not tag and (scores[i] > 0 or text.isspace()):
            held.append(text)
    blocks.append("".join(held))
    return "\n".join(x for x in (" ".join(x.split()) for x in blocks) if x)


def labelled(page: str) -> tuple[list[tuple[str, str, Node]], list[Node], list[bool]]:
    """A labelled page's items and elements, and which items are words of main text."""
    items, nodes = sequence(page)
    return items, nodes, [not tag and bool(text.strip()) and is_labelled(node) for tag, text, node in items]


def is_labelled(node: Node | None) -> bool:
    while node is not None:
        if found := LABEL.search(node.attributes):
            return found[1] == "main"
        node = node.parent
    return False


def learned(pages: Iterable[str], rounds: int = 600, strength: float = 2e-5, step: float = 1.0) -> Model:
    """Weights from labelled pages: a logistic model of elements, by gradient steps from zero, and log shares of tags."""
    rows: list[list[str]] = []
    truth: list[bool] = []
    within, without = Counter(), Counter()
    for page in pages:
        items, nodes, main = labelled(page)
        total = measured(items, nodes)
        holds: set[int] = set()
        for (_, _, node), is_main in zip(items, main, strict=True):
            while is_main and node is not None and id(node) not in holds:
                holds.add(id(node))
                node = node.parent
        for x in nodes:
            if x.words and is_judged(x) and (id(x) in holds or id(x.parent) in holds):  # what stands in a part without main text says nothing
                rows.append(features(x, total))
                truth.append(id(x) in holds)
        places = [i for i, x in enumerate(main) if x]
        low, high = (places[0], places[-1]) if places else (0, -1)
        for i, (tag, _, _) in enumerate(items):
            if tag:
                (within if low <= i <= high else without)[tag.lstrip("/")] += 1
    names = {x: i for i, x in enumerate(dict.fromkeys(x for row in rows for x in row))}
    which = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    index = np.array([names[x] for row in rows for x in row], np.int64)
    y = np.array(truth, float)
    w, slope = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    squares = np.full(len(names) + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(which, w[index], len(rows)) + w[-1]
        error = 1 / (1 + np.exp(-z)) - y
        slope[:-1] = np.bincount(index, error[which], len(names)) / len(rows) + strength * w[:-1]
        slope[-1] = error.mean()
        squares += slope**2
        w -= step * slope / np.sqrt(squares)
    weights = {x: float(w[i]) for x, i in names.items()} | {"": float(w[-1])}
    tags = {x: -0.01 - max(0.0, min(6.0, math.log2((without[x] + 1) / (within[x] + 1)))) / 16 for x in within | without}
    return Model(weights, tags | {"*": -0.1})


def labelled_pages(count: int = 2000, seed: int = 4) -> list[str]:
    """Pages of many layouts, made by rule."""
    rng = random.Random(seed)
    pick = rng.choice
    parts = "ba den ko li mar no per qui ros ta ven zu".split()

    def phrase(low: int, high: int) -> str:
        return " ".join("".join(pick(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def some(n: int, make) -> str:
        return "".join(make() for _ in range(n))

    def mark(tag: str, words: str, p: float = 0.75) -> str:
        """An element; most have some of the words as class or id, at times with others around them."""
        if rng.random() > p:
            return f"<{tag}>"
        own = pick(words.split())
        if rng.random() < 0.4:
            own = pick(["site-{}", "page-{}", "{}-slot", "{}-wrapper", "{}-area", "widget {}", "{} clearfix", "js-{}", "block-{}", "{}Box", "{}-1", "the_{}", "c-{}"]).format(own)
        return f'<{tag} {pick(["class", "class", "class", "id"])}="{own}">'

    link = lambda: f'<li><a href="/x">{phrase(1, 3)}</a></li>'
    links = lambda low=2, high=12: f"<ul>{some(rng.randint(low, high), link)}</ul>"

    def aside_part() -> str:
        """One part that is not main text."""

        def menu():
            tag = pick(["nav", "nav", "div", "menu"])
            return mark(tag, "menu nav navbar navigation topnav main-menu breadcrumb breadcrumbs pagination pager toc", 1 if tag == "div" else 0.5) + pick([links(), some(rng.randint(2, 9), lambda: f'<a href="/">{phrase(1, 2)}</a> ')]) + f"</{tag}>"

        def advert():
            tag = pick(["div", "div", "aside", "section", "span", "ins"])
            return mark(tag, "ad ads advert advertisement adsbygoogle banner promo sponsor sponsored sponsored-content taboola outbrain dfp", 1) + pick(["{}", "<p>{}</p>", "<a href=x>{}</a>", "<p>{}</p><p><a href=x>more</a></p>"]).format(phrase(2, 45)) + f"</{tag}>"

        def notice():
            tag = pick(["div", "div", "section", "aside", "dialog", "noscript", "p"])
            return mark(tag, "cookie cookie-notice cookies consent gdpr notice notification alert popup modal overlay disclaimer cookie-banner paywall message", 0.5 if tag in ("dialog", "noscript") else 1) + pick(["{}", "{}<button>ok</button>", "<p>{}</p>" * (tag != "p") or "{}"]).format(phrase(3, 60)) + f"</{tag}>"

        def shares():
            tag = pick(["div", "ul", "section", "p"])
            inner = some(rng.randint(2, 6), link) if tag == "ul" else some(rng.randint(2, 6), lambda: f'<a href="/s">{phrase(1, 2)}</a> ')
            return mark(tag, "share sharing social social-links share-buttons addtoany tags tag-links post-tags meta-links follow", 1) + inner + f"</{tag}>"

        def related():
            tag = pick(["div", "section", "aside"])
            return mark(tag, "related related-posts recommended recommendations more-stories teaser teasers popular trending latest read-next you-may-like", 1 if tag != "aside" else 0.5) + f"<h3>{phrase(1, 4)}</h3>" + pick([links(), some(rng.randint(2, 4), lambda: f"<div><h4><a href=x>{phrase(2, 8)}</a></h4><p>{phrase(4, 25)}</p></div>")]) + f"</{tag}>"

        def form():
            return mark("form", "newsletter subscribe signup login search search-form subscription contact-form register", 0.4) + pick(["{}<input name=q>", "<label>{}</label><input><textarea>{}</textarea>", "<p>{}</p><select><option>{}<option>b</select><input><button>go</button>"]).replace("{}", phrase(1, 14)) + "</form>"

        def hidden():
            return pick(['<div hidden>{}</div>', '<div style="display:none">{}</div>', '<span aria-hidden="true">{}</span>', '<p style="display: none">{}</p>', "<section hidden><p>{}</p></section>"]).format(phrase(1, 40))

        return pick([menu, advert, advert, notice, shares, related, form, hidden])()

    def aside(part: str) -> str:
        return re.sub(r"^<(\w+)", r"<\1 data-aside", part)

    def sidebar() -> str:
        tag = pick(["aside", "aside", "div", "section", "td"])
        body = some(rng.randint(1, 4), lambda: pick([f"<h3>{phrase(1, 3)}</h3>{links()}", f"<p>{phrase(5, 70)}</p>", aside_part(), f"<div><p>{phrase(5, 40)}</p><p>{phrase(5, 40)}</p></div>"]))
        return mark(tag, "sidebar side sidebar-right secondary widget-area right-column widgets rail complementary aside left-sidebar", 0.5 if tag == "aside" else 1) + body + f"</{tag}>"

    def comments() -> str:
        tag = pick(["div", "section", "ol", "ul", "aside"])
        inner = "li" if tag in ("ol", "ul") else pick(["div", "article", "p", "li", "section"])
        each = lambda: mark(inner, "comment comment-body reply user-comment review comment-content", 0.6) + pick(["{}", "<b>{}</b> {}", "<cite>{}</cite><p>{}</p>", "<p>{}</p><p>{}</p>"]).replace("{}", phrase(2, 60) if rng.random() < 0.8 else phrase(1, 4)) + f"</{inner}>"
        return mark(tag, "comments comment-list commentlist disqus_thread respond reader-comments responses discussion reviews comments-area replies", 1) + pick(["", f"<h2>{phrase(1, 3)}</h2>", f"<h3>{phrase(1, 3)}</h3>"]) * (tag not in ("ol", "ul")) + some(rng.randint(1, 12), each) + f"</{tag}>"

    def header() -> str:
        tag = pick(["header", "header", "div"])
        return mark(tag, "header masthead topbar site-header top logo branding toolbar page-header-bar", 0.6 if tag == "header" else 1) + pick([f"<h2>{phrase(1, 4)}</h2>", f'<a href="/">{phrase(1, 3)}</a>', f"<p>{phrase(1, 9)}</p>", f"<h1>{phrase(1, 3)}</h1>", f"<div>{phrase(1, 3)}</div>"]) + pick(["", aside_part(), links()]) + f"</{tag}>"

    def footer() -> str:
        tag = pick(["footer", "footer", "div"])
        return mark(tag, "footer site-footer bottom copyright colophon contentinfo foot page-footer legal", 0.5 if tag == "footer" else 1) + pick(["&copy; {}", "<p>{}</p>", "<div><p>{}</p></div>", "<small>{}</small>"]).format(phrase(2, 40)) + pick(["", links()]) + f"</{tag}>"

    def inline(text: str) -> str:
        words = text.split()
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(words))
            words[i] = pick(["<b>{}</b>", "<i>{}</i>", '<a href="/l">{}</a>', "<code>{}</code>", "<span>{}</span>", '<span class="highlight">{}</span>', "{}<br>", "<em>{}</em>", "<sup>{}</sup>", "<math><mi>{}</mi></math>", '<abbr title="x > y">{}</abbr>']).format(words[i])
        return " ".join(words)

    def body_part() -> str:
        """One part of a main text."""
        kind = rng.random()
        if kind < 0.66:
            return pick(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p><b>{}<br>", "<div>{}</div>", '<p class="lead">{}</p>', "<p class=intro>{}</p>", "{}<br><br>", '<div class="paragraph">{}</div>']).format(inline(phrase(*pick([(1, 6), (8, 40), (20, 120), (60, 200)]))))
        if kind < 0.74:
            return f"<h2>{phrase(1, 7)}</h2>" if kind < 0.71 else f"<h3>{phrase(1, 7)}</h3>"
        if kind < 0.82:
            return f"<ul>{some(rng.randint(2, 8), lambda: f'<li>{inline(phrase(1, 20))}</li>')}</ul>"
        if kind < 0.87:
            return f"<blockquote>{pick(['{}', '<p>{}</p>']).format(phrase(5, 50))}</blockquote>"
        if kind < 0.92:
            return f'<figure><img src="x">{mark("figcaption", "caption wp-caption-text", 0.3)}{phrase(2, 15)}</figcaption></figure>'
        if kind < 0.96:
            row = lambda: f"<tr>{some(3, lambda: f'<td>{phrase(1, 4)}</td>')}</tr>"
            return f"<table>{some(rng.randint(2, 6), row)}</table>"
        return f"<pre>{phrase(5, 40)}</pre>" if kind < 0.98 else f"<section><h2>{phrase(1, 5)}</h2><p>{phrase(10, 80)}</p></section>"

    def article() -> str:
        title = f"<h1>{phrase(1, 12)}</h1>"
        lead = pick(["", "", f'<p class="{pick(["subtitle", "byline", "dek", "summary", "standfirst"])}">{phrase(3, 20)}</p>'])
        head = pick([title + lead, title, f"<header>{title}{lead}</header>", mark("header", "entry-header post-header article-header") + f"{title}{lead}</header>", mark("div", "entry-header post-header article-header title-block headline page-title") + f"{title}{lead}</div>", f"<hgroup>{title}</hgroup>", f"<h2>{phrase(2, 9)}</h2>"])
        inner = [body_part() for _ in range(pick([1, 1, 1, 2, 2, 3, 5, 8, 14, 25]))]
        opened, closed = "", ""
        if rng.random() < 0.4:
            opened, closed = mark("div", "entry-content post-body article-body content body text story-body post-content richtext mw-parser-output"), "</div>"
        tag = pick(["article", "article", "main", "div", "div", "section", "td"])
        names = "content main-content post article entry story hentry page-content main primary post-single article-container blog-post text-content single news-item"
        out = mark(tag, names, 1 if tag == "div" and rng.random() < 0.8 else 0.4)
        out = out[:-1] + " data-main>"
        pieces = [head, opened, *inner, closed]
        for _ in range(pick([0, 0, 0, 1, 2])):
            pieces.insert(rng.randrange(1, len(pieces)), aside(aside_part()))
        if rng.random() < 0.25:
            pieces.append(aside(pick([comments, comments, sidebar, aside_part])()))
        out += "".join(pieces) + f"</{tag}>"
        if tag == "td":
            out = f"<table><tr>{out}{pick(['', sidebar() if rng.random() < 0.5 else ''])}</tr></table>"
        return out

    pages = []
    for _ in range(count):
        before = some(pick([0, 1, 1, 2, 3]), lambda: pick([header, header, aside_part])())
        after = some(pick([0, 1, 1, 2, 3, 4]), lambda: pick([footer, footer, comments, sidebar, aside_part])())
        body = pick([sidebar, str, str, str])() + article() + pick([sidebar, str, str])() + pick([comments, str, str])()
        for _ in range(pick([0, 1, 1, 2, 3])):  # wrappers hold main text, whatever their names say of their neighbours
            if rng.random() < 0.5:
                body = pick([header, aside_part, str, str])() + body + pick([footer, comments, str, str])()
            tag = pick(["div", "div", "div", "section", "main", "form"])
            body = mark(tag, "wrap wrapper container page site layout has-sidebar content-sidebar-wrap sidebar-layout no-sidebar row main search-results-page login-required with-nav header-fixed root app single-post has-comments comments-open theme-ad-free outer-wrap content-area two-column with-sidebar menu-open nav-open popup-enabled cookie-accepted logged-in footer-bottom archive", 0.85) + body + f"</{tag}>"
        open_body = mark("body", "home single post-template has-sidebar page no-js menu-closed logged-in customize-support search-results login modal-open sidebar-right nav-fixed", 0.4)
        page = f"<!DOCTYPE html><html><head><title>{phrase(1, 8)}</title></head>{open_body}{before}{body}{after}</body></html>"
        pages.append(page)
    return pages


@cache
def default_model() -> Model:
    return learned(labelled_pages())


def extracted(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every row."""
    model = model or default_model()

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, model) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    ready(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), whole(html_col).alias("html"))
    return rows.mapInArrow(apply, "page_id long, url string, text string, n_chars long")

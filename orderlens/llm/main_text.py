"""Main text of web pages by a graphical model over the tree of their elements.

Each element that shows something is a node with two states, article or not. A node has
evidence of its own (element, names in its attributes, how much text it has and how much
of that is links) and a potential with its parent, so that what a part is depends on
what it is part of. Messages passed from the leaves up and from the root down (sum
and product, in logarithms) give the exact marginal of each node. All potentials are
counted on labelled pages (``page_training``), which the model is fitted on when needed.

The text of a block element is what its nodes of probability 0.5 and more show. White space
in a block becomes one space, blocks are joined by an empty line, in the page's order.
Element names close as browsers close them: a block ends an open paragraph, a list item
another, and what is never closed ends with its parent.

Defined results: a null or empty page has empty text; a page of any length is read
whole; equal rows give equal results; an empty table gives no rows. Other columns of
the pages are kept, but for ``text`` and ``n_chars``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.page_training import LABELLED_PAGES

# HTML elements by what they do.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = set("head title script style template noscript svg math iframe object canvas audio video select button textarea datalist".split())
IN_HEAD = set("title meta link base script style noscript template".split())
BLOCKS = set(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table caption tbody thead tfoot "
    "tr td th ul".split()
)
# Which open elements a start tag closes, up to the elements that hold them.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
_ENDS_PARAGRAPH = BLOCKS - set("html body li dd dt tbody thead tfoot tr td th caption".split())
# An end tag reaches no further out than these, and a block's end tag closes all within.
_BARRIERS = {"td", "th", "table", "article", "section", "main", "body"}

# Parts of names that tell what an element is for, by kind.
NAME_KINDS = {
    "menu": "nav menu navigation breadcrumb breadcrumbs topbar toc pagination pager tabs navbar skip",
    "head": "header masthead banner logo branding top",
    "foot": "footer foot copyright colophon imprint legal",
    "side": "sidebar side aside widget rail related recommended recommendations more popular trending archive tags",
    "advert": "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion promoted banner-ad adsense dfp",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup message warning",
    "comment": "comment comments disqus discussion reply replies respond feedback responses",
    "share": "share sharing social follow",
    "form": "form search login register contact",
    "article": "article content post entry story main body text page-content maincontent articlebody",
}
_KIND_OF = {part: kind for kind, parts in NAME_KINDS.items() for part in parts.split()}
_NAME_PARTS = re.compile("[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
SMOOTHING = 0.1


class Node:
    __slots__ = ("tag", "kinds", "parent", "children", "items", "words", "link_words", "label", "variable")

    def __init__(self, tag: str, names: str, parent: Node | None, label: bool):
        self.tag, self.parent, self.label = tag, parent, label
        self.kinds = {_KIND_OF[part.lower()] for part in _NAME_PARTS.findall(names) if part.lower() in _KIND_OF} if names else set()
        # Emphasis, links and the like have the state of what they are in, unless they are named for something.
        self.variable = self if tag in BLOCKS or self.kinds else parent.variable
        self.children: list[Node] = []
        # What it shows, in order: texts and child nodes.
        self.items: list[str | Node] = []
        self.words = self.link_words = 0


class _Tree(HTMLParser):
    """Nodes of a page in the order of their start tags; unshown elements leave nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", "", None, False)
        self.nodes = [self.root]
        self.open = [self.root]
        self.skipped: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "body" or (self.skipped == ["head"] and tag not in IN_HEAD):
            self.skipped.clear()
        if self.skipped:
            if tag in UNSHOWN or tag in self.skipped:
                self.skipped.append(tag)
            return
        if tag in UNSHOWN:
            self.skipped.append(tag)
            return
        attributes = dict(attrs)
        if tag in ("html", "body"):
            self._mark(self.open[-1] if tag == "body" else self.root, attributes)
            return
        if tag in _ENDS_PARAGRAPH:
            self._close({"p"}, _BARRIERS | {"button"})
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if "hidden" in attributes or attributes.get("aria-hidden") == "true":
            if tag not in VOID:
                self.skipped.append(tag)
            return
        parent = self.open[-1]
        names = " ".join(attributes.get(a) or "" for a in ("class", "id", "role", "itemprop"))
        node = Node(tag, names, parent, parent.label)
        self._mark(node, attributes)
        parent.children.append(node)
        parent.items.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def _mark(self, node, attributes):
        if "data-main" in attributes:
            node.label = True
        elif "data-not" in attributes:
            node.label = False

    def _close(self, tags: set[str], holders: set[str]):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in holders:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                # A row closes its cells, a body its rows.
                self._close(tags, holders)
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in UNSHOWN and self.skipped:
            self.skipped.pop()

    def handle_endtag(self, tag):
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in _BARRIERS and tag not in BLOCKS:
                return

    def handle_data(self, data):
        if not self.skipped and data:
            self.open[-1].items.append(data)


def parsed(html: str | None) -> list[Node]:
    """The nodes of a page that have a state, parents before children, with how many words each shows and how many in links."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    for node in reversed(tree.nodes):
        own = sum(len(item.split()) for item in node.items if type(item) is str)
        node.words = own + sum(child.words for child in node.children)
        node.link_words = node.words if node.tag == "a" else sum(child.link_words for child in node.children)
    return [node for node in tree.nodes if node.variable is node]


_GROUPS = {"article": "article", "main": "main", "nav": "nav", "footer": "footer", "aside": "aside", "header": "header", "form": "form"}
_GROUPS |= dict.fromkeys("input label fieldset legend option".split(), "form")
_GROUPS |= dict.fromkeys("h1 h2 h3 h4 h5 h6 hgroup".split(), "heading")
_GROUPS |= dict.fromkeys("ul ol menu li dl dt dd".split(), "list")
_GROUPS |= dict.fromkeys("table caption tbody thead tfoot tr td th".split(), "table")
_GROUPS |= {"div": "div", "section": "section", "p": "p", "pre": "pre", "blockquote": "quote", "a": "a", "html": "root"}


def features(node: Node) -> tuple[str, ...]:
    """Element, kinds of names, amount of text and share of links."""
    amount = "none" if not node.words else "few" if node.words < 10 else "some" if node.words < 40 else "many"
    share = 4 * node.link_words // node.words if node.words else 0
    return (f"element {_GROUPS.get(node.tag, 'inline')}", *sorted(f"name {k}" for k in node.kinds), f"words {amount}", f"links {min(share, 3)}")


class Model:
    """Log potentials of features per state, and of a node's state given its parent's.

    What a node is named for decides whether it may differ from its parent, so there is
    a table of steps for each kind of name, and one for nodes without.
    """

    def __init__(self, pages: list[str]):
        seen = {True: Counter(), False: Counter()}
        sizes = Counter()
        steps = {kind: Counter() for kind in ("plain", *NAME_KINDS)}
        for page in pages:
            for node in parsed(page):
                state = node.label
                sizes[state] += 1
                seen[state].update(set(features(node)))
                if node.parent is not None:
                    for kind in node.kinds or ("plain",):
                        steps[kind][node.parent.variable.label, state] += 1
        known = set(seen[True]) | set(seen[False])
        self.features = {
            f: tuple(math.log((seen[s][f] + SMOOTHING) / (sizes[s] + 2 * SMOOTHING)) for s in (False, True)) for f in known
        }
        self.steps = {
            kind: tuple(
                tuple(math.log((n[p, s] + SMOOTHING) / (n[p, False] + n[p, True] + 2 * SMOOTHING)) for s in (False, True))
                for p in (False, True)
            )
            for kind, n in steps.items()
        }

    def step(self, node: Node) -> tuple[tuple[float, float], tuple[float, float]]:
        """Log potentials by state of the parent and of the node; names for anything but an article go first."""
        return self.steps[min(node.kinds, key=lambda kind: (kind == "article", kind), default="plain")]

    def evidence(self, node: Node) -> tuple[float, float]:
        no = yes = 0.0
        for feature in features(node):
            a, b = self.features.get(feature, (0.0, 0.0))
            no, yes = no + a, yes + b
        return no, yes

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability that each node is article, by messages up and down the tree."""
        place = {id(node): i for i, node in enumerate(nodes)}
        local = [self.evidence(node) for node in nodes]
        up = list(local)
        to_parent: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
        steps = [self.step(node) for node in nodes]
        for i in range(len(nodes) - 1, 0, -1):
            no, yes = up[i]
            (nn, ny), (yn, yy) = steps[i]
            message = _log_sum(nn + no, ny + yes), _log_sum(yn + no, yy + yes)
            to_parent[i] = message
            j = place[id(nodes[i].parent.variable)]
            up[j] = up[j][0] + message[0], up[j][1] + message[1]
        down: list[tuple[float, float]] = [(0.0, 0.0)] * len(nodes)
        result = []
        for i, node in enumerate(nodes):
            if i:
                j = place[id(node.parent.variable)]
                (nn, ny), (yn, yy) = steps[i]
                no = up[j][0] + down[j][0] - to_parent[i][0]
                yes = up[j][1] + down[j][1] - to_parent[i][1]
                down[i] = _log_sum(nn + no, yn + yes), _log_sum(ny + no, yy + yes)
            difference = up[i][0] + down[i][0] - up[i][1] - down[i][1]
            result.append(1 / (1 + math.exp(min(700.0, difference))))
        return result


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


@cache
def trained() -> Model:
    return Model(LABELLED_PAGES)


def main_text(html: str | None, model: Model | None = None) -> str:
    nodes = parsed(html)
    marginals = (model or trained()).marginals(nodes)
    kept = {id(node) for node, p in zip(nodes, marginals) if p >= 0.5}
    blocks: list[list[str]] = [[]]
    # A stack instead of recursion, as pages nest to any depth.
    stack: list[tuple[Node, Iterator]] = [(nodes[0], iter(nodes[0].items))]
    while stack:
        node, items = stack[-1]
        for item in items:
            if type(item) is str:
                if id(node.variable) in kept:
                    blocks[-1].append(item)
            elif item.tag == "br":
                blocks[-1].append(" ")
            else:
                if item.tag in BLOCKS:
                    blocks.append([])
                stack.append((item, iter(item.items)))
                break
        else:
            stack.pop()
            if node.tag in BLOCKS:
                blocks.append([])
    texts = (_SPACE.sub(" ", "".join(block)).strip(" ") for block in blocks)
    return "\n\n".join(text for text in texts if text)


def extracted(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """The pages without their markup: other columns, ``text`` and ``n_chars``, its code points."""
    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = trained()
        for batch in batches:
            yield batch.map(lambda page: main_text(page, model))

    others = [c for c in pages.columns if c.lower() not in (html_column.lower(), "text", "n_chars")]
    return pages.select(*others, text(html_column).alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))

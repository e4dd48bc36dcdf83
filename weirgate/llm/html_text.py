"""Main text of web pages by minimum-cut labelling.

A page is split into blocks of text inside a tree of elements. Blocks and elements are the nodes of a graph.
A linear classifier gives each node a cost of being called content and one of being called boilerplate, the
capacities of its edges to the two terminals: a block is judged by its words, sentence end and links, an
element by its tag and, if it is a container, by its name. Smoothness edges join blocks that follow one
another, a block and its element, and an element and its parent. The side of the source in a minimum cut is
the content. Text that nothing speaks against is content, so a page without boilerplate keeps all of its text.

A block's own costs are weaker than its edge to its element, so short blocks go with what is around them,
and an element's costs and edges grow with the number of its blocks, so long lists weigh no more than short
ones against their surroundings.

Nodes whose own costs outweigh all their edges have the same label in every minimum cut; they are settled
first and pass their edges on to their neighbours' terminals, and the flow runs on the rest.

Defined results: null and empty html give an empty text; unclosed and stray tags are read as a browser
would at block level, in time linear in the page, however long; of several minimum cuts the one with the
fewest content nodes counts; repeated rows stay rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from weirgate.llm.common import text_chunks

OPENING = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)")
SPECIAL = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "title"}
BLOCK = {
    "html", "head", "body", "p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "fieldset", "figure", "figcaption", "blockquote", "pre",
    "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "hr", "address", "details",
    "summary", "dialog", "menu", "select", "option", "button", "center", "hgroup", "search", "legend", "label",
}
VOID = {"hr"}
#: What an opening tag closes: the nearest of these, if it is open inside the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: The classifier. Elements that hold boilerplate, and such that hold the content.
BOILER_TAGS = {"head", "nav", "header", "footer", "aside", "form", "fieldset", "dialog", "menu", "select", "option", "button", "search", "label", "legend"}
MAIN_TAGS = {"article", "main"}
#: Containers, whose class, id, role and itemprop may tell what they hold.
NAMED_TAGS = {"article", "div", "section", "ul", "ol", "dl", "table", "figure", "details"}
BOILER_NAMES = {
    "nav", "navbar", "navigation", "menu", "submenu", "header", "masthead", "topbar", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "promo",
    "promos", "promotion", "sponsor", "sponsored", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "alerts", "popup", "modal", "overlay", "comment", "comments",
    "commenter", "adsbygoogle", "adsense", "disqus", "discussion", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "subscribe", "subscription", "newsletter", "copyright", "toolbar", "login", "signin", "signup", "search", "contentinfo", "complementary", "form", "hidden",
}
#: Those of them that mean lists of links; they also name what prose is about, so they count for blocks that are no prose.
LINK_NAMES = {"nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toolbar"}
#: What may stand beside such a word in a name, as in comment-list or site_footer; any other word makes it a name of something else.
FILLER = {
    "site", "page", "main", "global", "primary", "secondary", "top", "bottom", "left", "right", "upper", "lower", "box", "bar", "list", "wrapper", "wrap", "container", "area", "inner", "outer",
    "section", "block", "content", "link", "links", "item", "items", "slot", "unit", "panel", "group", "module", "body", "holder", "region", "widget", "widgets", "thread", "reader", "user",
    "post", "posts", "story", "stories", "article", "articles", "text", "media", "icons", "buttons", "message", "policy", "dialog", "js", "b", "mobile", "desktop", "sticky", "fixed",
}
MAIN_NAMES = {"article", "articlebody", "main", "content", "post", "entry", "story", "body", "text"}
#: Costs of a block (above 0: rather content), and of an element for each block that it holds.
WEIGHTS = {"prior": -0.8, "words": 1.6, "sentence": 0.4, "links": -1.2, "outside_main": -2.0}
#: The same where no element says that it holds the main text: what nothing speaks against is content, however short.
UNMARKED = {"prior": 1.0, "words": 0.2, "sentence": 0.2, "links": -1.9, "outside_main": 0.0}
ELEMENTS = {"boiler_tag": -7.0, "main_tag": 7.0, "boiler_name": -5.0, "main_name": 1.0, "hidden": -20.0, "outside_main": -3.0}
#: What a sentence may end with.
ENDS = ".!?…:;\"'»”"
#: Smoothness: between neighbouring blocks, a block and its element, an element and its parent (and more for each block,
#: unless its tag or name says that something of its own begins there).
FOLLOWS, INSIDE, NESTED, NESTED_BLOCK = 0.4, 2.5, 0.5, 1.6


class Block(NamedTuple):
    text: str
    link_chars: int
    element: int


class Element:
    """An open or closed element: its parent, what is known of it, and whether it lies in an article."""

    __slots__ = ("blocks", "cost", "headline", "listing", "main", "parent", "tag", "thin")

    def __init__(self, tag: str, parent: int, cost: float, listing: float, main: bool, headline: int):
        self.tag, self.parent, self.cost, self.listing, self.main, self.headline, self.blocks, self.thin = tag, parent, cost, listing, main, headline, 0, 0


def words_in(name: str) -> list[str]:
    """The words of a class or id in lower case, without numbers and sizes as in ad-300x250."""
    return [w.lower() for w in re.findall(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*", re.sub(r"\d+(?:x\d+)?", " ", name))]


def means_boilerplate(name: str) -> bool:
    """Whether all words of a class or id are names of boilerplate or fillers, and one at least the former."""
    found = False
    for word in words_in(name):
        if word in BOILER_NAMES:
            found = True
        elif word not in FILLER:
            # Two words in one, as in commentlist or sitefooter; none of the words above has over 20 letters.
            parts = [(word[:i], word[i:]) for i in range(2, len(word) - 1)] if len(word) <= 40 else []
            if not any(x in BOILER_NAMES and (y in FILLER or y in BOILER_NAMES) or x in FILLER and y in BOILER_NAMES for x, y in parts):
                return False
            found = True
    return found


def evidence(tag: str, attributes: str) -> tuple[float, float, bool]:
    """What an element's tag, names and visibility say of each of its blocks, what they say of blocks that are no prose, and whether it is an article."""
    cost = ELEMENTS["boiler_tag"] * (tag in BOILER_TAGS)
    boiler = listing = main = False
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role", "itemprop") and tag in NAMED_TAGS:
            for x in value.split():
                if means_boilerplate(x):
                    links = any(w in LINK_NAMES for w in words_in(x))
                    boiler, listing = boiler or not links, listing or links
                else:
                    main = main or any(w in MAIN_NAMES for w in (*words_in(x), x.lower()))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            cost += ELEMENTS["hidden"]
    # An article that is named a comment, and nothing else, is one; of an article's other names none outweighs its tag.
    article = tag in MAIN_TAGS and (main or not boiler)
    if article:
        return cost + ELEMENTS["main_tag"], 0.0, True
    return cost + (ELEMENTS["boiler_name"] if boiler else ELEMENTS["main_name"] * (main and not listing)), ELEMENTS["boiler_name"] * (listing and not boiler), False


class Page:
    """A page's blocks of text in order, and its elements, parents first; the first one stands for the page."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.elements = [Element("", 0, 0.0, 0.0, False, 0)]
        self._stack = [0]
        self._open: dict[str, int] = {}
        #: Places in the stack of the elements that each rule of CLOSES looks at.
        self._seen: dict[str, list[int]] = {tag: [] for tag in CLOSES}
        self._read(page)

    def _push(self, tag: str, attributes: str) -> None:
        up = self._stack[-1]
        parent = self.elements[up]
        cost, listing, article = evidence(tag, attributes)
        # An article's own headline in its header is the article's.
        headline = up if tag == "header" and parent.main else parent.headline if tag in HEADINGS else 0
        self.elements.append(Element(tag, up, cost, listing, parent.main or article, headline))
        for rule, (which, within) in CLOSES.items():
            if tag in which or tag in within:
                self._seen[rule].append(len(self._stack))
        self._stack.append(len(self.elements) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _cut(self, size: int) -> None:
        """Close elements until the stack has `size`."""
        while len(self._stack) > size:
            self._open[self.elements[self._stack.pop()].tag] -= 1
        for seen in self._seen.values():
            while seen and seen[-1] >= size:
                seen.pop()

    def _top(self) -> str:
        return self.elements[self._stack[-1]].tag

    def _close(self, tag: str) -> None:
        if self._open.get(tag):
            size = len(self._stack)
            while self.elements[self._stack[size - 1]].tag != tag:
                size -= 1
            self._cut(size - 1)

    def _before(self, tag: str) -> None:
        """Close what an opening tag ends."""
        if self._top() == "p" or self._top() in HEADINGS and tag in HEADINGS:
            self._cut(len(self._stack) - 1)
        seen = self._seen.get(tag)
        if seen and self.elements[self._stack[seen[-1]]].tag in CLOSES[tag][0]:
            self._cut(seen[-1])

    def _add_block(self, pieces: list[str], link_chars: int) -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            at = self._stack[-1]
            if self.elements[at].tag in HEADINGS:
                at = self.elements[at].headline or at
            self.blocks.append(Block(text, min(link_chars, len(text)), at))
            self.elements[at].blocks += 1
            self.elements[at].thin += not is_prose(self.blocks[-1])

    def _tag_end(self, at: int) -> int:
        """The place behind the tag whose attributes begin at `at`: behind the first > outside quotes, or else the first one; -1 if there is none.

        What follows a quote or > is the same from wherever one came to it, so each is looked at once in a page.
        """
        page, ends, passed = self._page, self._ends, []
        m = SPECIAL.search(page, at)
        end = -1
        while m:
            i = m.start()
            if i in ends:
                end = ends[i]
                break
            passed.append(i)
            if page[i] == ">":
                end = i + 1
                break
            close = page.find(page[i], i + 1)
            m = SPECIAL.search(page, close + 1) if close >= 0 else None
        for i in passed:
            ends[i] = end
        return end if end >= 0 else page.find(">", at) + 1 or -1

    def _read(self, page: str) -> None:
        pieces: list[str] = []
        at, size, links, link_chars = 0, len(page), False, 0
        last = page.rfind(">")
        self._page, self._ends = page, {}
        while at < size:
            m = OPENING.search(page, at)
            comment = m is not None and m[0] == "<!--"
            # Behind the last > there are no tags, only the text and what an open comment hides.
            while m and not comment and m.end() > last:
                start = page.find("<!--", m.end())
                m = OPENING.match(page, start) if start >= 0 else None
                comment = m is not None
            end = m.start() if m else size
            if end > at:
                pieces.append(page[at:end])
                link_chars += (end - at) * links
            if not m:
                break
            if comment:
                close = page.find("-->", m.end())
                at = close + 3 if close >= 0 else size
                continue
            at = self._tag_end(m.end()) if m[2] else page.find(">", m.end()) + 1
            if not m[2]:
                continue
            attributes = page[m.end() : at - 1]
            tag, closing = m[2].lower(), m[1] == "/"
            if tag in RAW:
                if not closing and not attributes.rstrip().endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at, last + 1)
                    at = close.end() if close else size
            elif tag == "a":
                links = not closing
            elif tag == "br":
                pieces.append(" ")
            elif tag in BLOCK:
                self._add_block(pieces, link_chars)
                pieces, links, link_chars = [], False, 0
                if closing:
                    self._close(tag)
                else:
                    self._before(tag)
                    if tag not in VOID:
                        self._push(tag, attributes)
        self._add_block(pieces, link_chars)

    def graph(self) -> tuple[list[float], list[dict[int, float]]]:
        """Costs and edges of the nodes: all blocks, then the elements that hold some."""
        n = len(self.blocks)
        mass, thin = [e.blocks for e in self.elements], [e.thin for e in self.elements]
        for i in range(len(mass) - 1, 0, -1):
            mass[self.elements[i].parent] += mass[i]
            thin[self.elements[i].parent] += thin[i]
        in_main = sum(e.blocks for e in self.elements if e.main)
        node = {}
        for i, m in enumerate(mass):
            if m:
                node[i] = n + len(node)
        weights = WEIGHTS if in_main else UNMARKED
        gain = [block_cost(b, not self.elements[b.element].main, weights) for b in self.blocks] + [0.0] * len(node)
        edges: list[dict[int, float]] = [{} for _ in gain]

        def join(i: int, j: int, weight: float) -> None:
            edges[i][j] = edges[j][i] = edges[i].get(j, 0.0) + weight

        own = [e.cost * m + e.listing * t for e, m, t in zip(self.elements, mass, thin)]
        # The nearest element that says something of its own. On pages that do not mark their main text, nothing is smoothed across its border.
        region = [0] * len(own)
        for i in range(1, len(own)):
            region[i] = i if own[i] else region[self.elements[i].parent]
        for i, b in enumerate(self.blocks):
            join(i, node[b.element], INSIDE)
            if i and (in_main or region[b.element] == region[self.blocks[i - 1].element]):
                join(i - 1, i, FOLLOWS)
        for i, at in node.items():
            gain[at] = own[i]
            if i and not in_main and own[i]:
                continue
            if i:
                join(at, node[self.elements[i].parent], NESTED + NESTED_BLOCK * mass[i] * (own[i] == 0))
            elif in_main:
                gain[at] += ELEMENTS["outside_main"] * (n - in_main)
        return gain, edges


def is_prose(block: Block) -> bool:
    """A sentence of some length that is not mostly links."""
    return block.text.count(" ") >= 5 and block.text[-1] in ENDS and block.link_chars * 2 < len(block.text)


def block_cost(block: Block, outside_main: bool, weights: dict[str, float]) -> float:
    """Above 0: rather content."""
    words = block.text.count(" ") + 1
    total = weights["prior"] + weights["words"] * min(1.0, words / 12) + weights["outside_main"] * outside_main
    total += weights["links"] * (block.link_chars / len(block.text))
    return total + weights["sentence"] * (block.text[-1] in ENDS)


def min_cut(gain: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """Source side of a minimum cut: gain > 0 is capacity from the source, gain < 0 to the sink; edges go both ways."""
    n = len(gain)
    gain, edges = list(gain), [dict(e) for e in edges]
    weight = [sum(e.values()) for e in edges]
    label: list[bool | None] = [None] * n
    work = list(range(n))
    while work:
        i = work.pop()
        if label[i] is None and abs(gain[i]) > weight[i] + 1e-9:
            label[i] = gain[i] > 0
            for j, w in edges[i].items():
                gain[j] += w if label[i] else -w
                weight[j] -= w
                del edges[j][i]
                work.append(j)
            edges[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        where = {x: k for k, x in enumerate(rest)}
        for i, side in zip(rest, max_flow([gain[i] for i in rest], [{where[j]: w for j, w in edges[i].items()} for i in rest]), strict=True):
            label[i] = side
    return [bool(x) for x in label]


def max_flow(gain: list[float], edges: list[dict[int, float]]) -> list[bool]:
    """Nodes that the source still reaches after a maximum flow, by blocking flows along shortest paths.

    Each phase raises the length of the shortest path, so there are at most as many as nodes, and few in the
    shallow graphs of pages; a phase looks at every edge once beside its pushes.
    """
    n, small = len(gain), 1e-9
    left = [max(0.0, g) for g in gain]
    room = [max(0.0, -g) for g in gain]
    while True:
        level = [-1] * n
        queue = [i for i in range(n) if left[i] > small]
        for i in queue:
            level[i] = 0
        end = None
        for i in queue:
            if end is not None and level[i] >= end:
                break
            if room[i] > small:
                end = level[i]
            for j, c in edges[i].items():
                if c > small and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if end is None:
            return [x >= 0 for x in level]
        todo = [list(e) for e in edges]
        for start in [i for i in range(n) if left[i] > small]:
            path = [start]
            while path and left[start] > small:
                i = path[-1]
                if room[i] > small:
                    amount = min(left[start], room[i], *(edges[a][b] for a, b in zip(path, path[1:])))
                    left[start] -= amount
                    room[i] -= amount
                    for a, b in zip(path, path[1:]):
                        edges[a][b] -= amount
                        edges[b][a] = edges[b].get(a, 0.0) + amount
                    keep = next((k for k, (a, b) in enumerate(zip(path, path[1:])) if edges[a][b] <= small), len(path) - 1)
                    del path[keep + 1 :]
                    continue
                ahead = None
                while todo[i] and ahead is None:
                    j = todo[i][-1]
                    if level[j] == level[i] + 1 and edges[i][j] > small:
                        ahead = j
                    else:
                        todo[i].pop()
                if ahead is not None:
                    path.append(ahead)
                else:
                    path.pop()
                    if path:
                        todo[path[-1]].pop()


def main_text(page: str | None) -> str:
    """The content blocks in page order, joined by two newlines."""
    read = Page(page or "")
    labels = min_cut(*read.graph())
    return "\n\n".join(b.text for b, content in zip(read.blocks, labels) if content)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

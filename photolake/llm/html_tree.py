"""A forgiving reader of HTML into a small tree of blocks, and simple tree matching of two such trees."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np

#: Elements by the way they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents aren't text of the page; those of the first kind swallow all up to their end.
SWALLOWS = frozenset("script style textarea title noscript template iframe".split())
RAW = SWALLOWS | frozenset("svg select object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section main div body nav aside header footer form blockquote".split())
BOILER_TAGS = frozenset("nav header footer aside form button menu dialog head".split())
#: Words in a class or id that name what isn't the article.
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disqus "
    "foot footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promos promotion recommended related reply replies respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split()
)
ARTICLE = frozenset(["article", "main"])
#: Elements of running text. A name rules one out only as a whole word of its class, not as a part of one.
FLOW = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6 li dd dt td th tr figure figcaption".split())
#: Words among these that name what readers add.
REMARKS = frozenset("comment comments disqus replies reply respond".split())

_tag = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_named = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_white = re.compile(r"\s+")
_parts = re.compile(r"[-_:]|(?<=[a-z])(?=\d)")


@dataclass(eq=False, slots=True)
class Text:
    """A block of text, and how many of its characters are in links."""

    text: str
    links: int


@dataclass(eq=False, slots=True)
class Node:
    """An element that isn't inline. ``items`` are its texts and child nodes in order; ``names`` the words of its
    class, id and role but for those with digits; ``boiler``: tag or names say that it is no part of an article."""

    tag: str
    names: tuple[str, ...]
    boiler: bool
    items: list = field(default_factory=list)
    shape: int = 0

    @property
    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def _new(tag: str, attributes: str, in_article: bool) -> Node:
    words = [w for m in _named.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()] if "=" in attributes else []
    boiler = tag in BOILER_TAGS and not (tag == "header" and in_article)  # an article's own header has its heading
    boiler = boiler or any(p in BOILER_WORDS for w in words for p in ([w] if tag in FLOW else _parts.split(w)))
    return Node(tag, tuple(sorted({w for w in words if not any(c.isdigit() for c in w)})), boiler)


def read(page: str) -> Node:
    """The tree of a page. Scripts, styles and comments are gone; inline elements are part of their block's text.

    A self-closed element without text of its own is empty. Scripts and the like without an end take the rest of
    the page; drawings, lists to choose from, and players without one take nothing.
    """
    root = Node("#", (), False)
    made, stack, open_tags = [root], [root], Counter()
    text: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _white.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                stack[-1].items.append(Text(joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def add(part: str) -> None:
        nonlocal linked
        if part:
            text.append(part)
            if links:
                linked += len(part.strip())

    def close(tags: set | frozenset, until: frozenset) -> None:
        if not any(open_tags[x] for x in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                open_tags.subtract(x.tag for x in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in until:
                return

    at = 0
    while m := _tag.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag = tag.lower()
        if tag in VOID:
            if tag in ("br", "hr"):
                add(" ")
        elif tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if end else links + 1
        elif end:
            close({tag}, SCOPES - {tag})
        elif tag in RAW:
            add(" ")
            empty = attributes.rstrip().endswith("/") and tag not in SWALLOWS
            if not empty:
                found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if found:
                    at = found.end()
                elif tag in SWALLOWS and not attributes.rstrip().endswith("/"):
                    at = len(page)
        else:
            flush()
            close({"p"}, SCOPES)
            if tag in CLOSES:
                close(CLOSES[tag], SCOPES)
            node = _new(tag, attributes, bool(open_tags["article"] or open_tags["main"]))
            stack[-1].items.append(node)
            made.append(node)
            stack.append(node)
            open_tags[tag] += 1
    if at < len(page) and not page.startswith("<", at):
        add(page[at:])
    flush()
    for node in reversed(made):  # children come after their parents
        node.shape = hash((node.tag, node.names, tuple(k for k, _ in groupby(x.shape for x in node.children))))
    return root


@dataclass(eq=False, slots=True)
class Slot:
    """A place of a tree: a node, or a run of like siblings, which count as one."""

    nodes: list[Node]
    children: list[Slot]
    shape: int

    @property
    def tag(self) -> str:
        return self.nodes[0].tag

    @property
    def names(self) -> tuple[str, ...]:
        return self.nodes[0].names

    @property
    def boiler(self) -> bool:
        return self.nodes[0].boiler


def slots(root: Node) -> list[Slot]:
    """The tree for matching, parents before their children: neighbours of one tag and names that hold no blocks, or
    the same ones inside, are one slot of many texts."""
    order = [Slot([root], [], 0)]
    for slot in order:
        own: list[list[Node]] = []
        for child in [c for n in slot.nodes for c in n.children]:
            last = own[-1][-1] if own else None
            if last and last.tag == child.tag and last.names == child.names and (last.shape == child.shape or not (last.children or child.children)):
                own[-1].append(child)
            else:
                own.append([child])
        slot.children = [Slot(x, [], 0) for x in own]
        order += slot.children
    for slot in reversed(order):
        slot.shape = hash((slot.tag, slot.names, tuple(x.shape for x in slot.children)))
    return order


#: Weight of a pair of slots; equal names count one more, so they only decide between alignments of as many pairs.
PAIR = 1 << 20
#: Cells of a table from which rows are worked on as arrays.
TABLE_CELLS = 256


class Matcher:
    """Simple tree matching: the most pairs of slots with equal tags that keep order and ancestry."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}

    def weight(self, a: Slot, b: Slot) -> int:
        """Of the best alignment of two trees whose roots are aligned, 0 where they can't be. Trees of equal shapes weigh the same."""
        waiting = [(a, b)]
        while waiting:  # depth first, without recursion: pages may be nested to any depth
            x, y = waiting[-1]
            if (x.shape, y.shape) in self.known:
                waiting.pop()
                continue
            if x.tag != y.tag:
                self.known[x.shape, y.shape] = 0
                continue
            own, others = ({s.shape: s for s in z.children}.values() for z in (x, y))
            need = [(p, q) for p in own for q in others if p.tag == q.tag and (p.shape, q.shape) not in self.known]
            if need:
                waiting += need
                continue
            self.known[x.shape, y.shape] = PAIR + (x.names == y.names) + self.chain(x.children, y.children)[0]
        return self.known[a.shape, b.shape]

    def of(self, p: Slot, q: Slot) -> int:
        return self.known[p.shape, q.shape] if p.tag == q.tag else 0

    def chain(self, x: list[Slot], y: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
        """Weight and places of the best pairs of two lists, rising in both."""
        if not x or not y:
            return 0, []
        if len(x) * len(y) > TABLE_CELLS:
            return self.long_chain(x, y)
        w = [[self.of(p, q) for q in y] for p in x]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w[i][j])
        i, j, pairs = len(x), len(y), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((i, j))
        return best[-1][-1], pairs[::-1]

    def long_chain(self, x: list[Slot], y: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
        """The same for long lists in linear space: rows as arrays, and the lists halved again and again."""
        kinds = {s.shape: s for s in x}
        others = {s.shape: s for s in y}
        at, number = {s: i for i, s in enumerate(others)}, np.array([0] * len(y))
        number[:] = [at[s.shape] for s in y]
        rows = {k: np.array([self.of(p, q) for q in others.values()], "int64")[number] for k, p in kinds.items()}
        w = [rows[s.shape] for s in x]

        def ends(part: list[np.ndarray], lo: int, hi: int, step: int) -> np.ndarray:
            best = np.zeros(hi - lo + 1, "int64")
            for row in part[::step]:
                own = row[lo:hi][::step]
                best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + own))
            return best

        pairs, parts = [], [(0, len(x), 0, len(y))]
        while parts:
            i, i2, lo, hi = parts.pop()
            if i == i2 or lo == hi:
                continue
            if i2 - i == 1:
                j = lo + int(np.argmax(w[i][lo:hi]))
                if w[i][j]:
                    pairs.append((i, j))
                continue
            mid = (i + i2) // 2
            cut = lo + int(np.argmax(ends(w[i:mid], lo, hi, 1) + ends(w[mid:i2], lo, hi, -1)[::-1]))
            parts += [(i, mid, lo, cut), (mid, i2, cut, hi)]
        pairs.sort()
        return int(sum([w[i][j] for i, j in pairs])), pairs

    def match(self, a: Slot, b: Slot) -> list[tuple[Slot, Slot]]:
        """The aligned slots, parents before their children."""
        if not self.weight(a, b):
            return []
        pairs = [(a, b)]
        for p, q in pairs:
            pairs += [(p.children[i], q.children[j]) for i, j in self.chain(p.children, q.children)[1]]
        return pairs

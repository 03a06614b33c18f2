"""Main text of web pages by wrapper induction.

Pages become trees of elements and text blocks; elements without text go, and neighbours of the same
shape are folded into one slot. The wrapper of a host is the union of the trees of all its pages, merged
by simple tree matching: the largest order-keeping matching of nodes with equal tag and class, found level
by level. So a host has a slot for whatever any page of any layout shows. Equal trees are merged once;
those of a layout are united in `references` tasks side by side, then those unions, commonest layout
first. A union of more than `most_slots` slots is not cut: the tree that does not fit begins a further
wrapper of the host (a volume), which the pages of that tree are read by. Trees that are larger by
themselves have volumes of their own, of up to twice the largest. Every page is then aligned with the
wrapper that holds its tree, and each slot is judged by what it holds across the pages: on how many pages
it occurs, how many of its characters are links or in elements that are never an article's text, and which
of its texts recur. Pages whose longest block is the same count once, so copies of one article do not
become template.

From the root, the wrapper's content is looked for downwards: as long as beside the slot with most
varying text there are others that hold links, never-text or template, the search goes on below it (below
each of several, if no two of them occur on one page). What it ends at is the host's article, with or
without telling tags. Of a page's part that is aligned with it, these go: recurring texts, lists of
links, and what tags and whole class, id and role names set aside (scripts, styles, menus, headers,
footers, sidebars, forms, adverts, notices, reader comments; such names do not count on html, body, main
or what holds main, on an article only if there is another, and not at all where they would leave
nothing). Where a page marks articles within that part, only these; where it marks them only elsewhere,
those. Hosts with one page, and pages that align with none of it, are read by tags and names alone; pages
of a further volume with fewer than `least_pages` different ones are read by the host's first.

A wrapper is a few hundred labels and numbers for most hosts, and travels to the pages by a broadcast of
checked size or else by a join salted over `SALTS` tasks a host; what pages show is aggregated before it
is shuffled. So a host of any size is dealt with in parallel, but for the last merging of its unions, at
least one for each layout, which is one task.

Defined cases: a null or empty html gives an empty text; a null or hostless url has no host and is read
by tags alone; broken markup is read as far as it goes; repeated rows are each read; pages of any length
are merged, aligned and read whole; child lists of any length are
aligned in linear memory, but once `Matching.MOST` pairs of unequal subtrees of a page have been
compared, further ones count by their labels alone; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.scratch import Scratch

# Element names of the HTML standard, by what they do to text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
NEVER = frozenset("aside audio button canvas datalist dialog footer form head iframe input map menu meter nav noembed noframes noscript object option output progress script select style svg template textarea title video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select", "datalist"}}
# Words that mark, as a class, id or role, what is not the article; and words that may stand
# beside them in one with hyphens or underscores. Any other word there ("no-sidebar", "comments-open") says
# something else.
MARK = re.compile(r"ads?|advert[a-z0-9]*|adsense|banner|breadcrumbs?|comments?|complementary|consent|contentinfo|cookies?|disclaimer|discussion|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo[a-z0-9]*|recommend[a-z0-9]*|related|replies|reply|respond|responses|search|share|sharing|sidebar|signup|social|sponsor[a-z0-9]*|subscribe|subscription|teaser|toolbar|widget", re.I)
BESIDE = re.compile(r"\d[a-z0-9]*|area|bar|block|bottom|box|btn|button|buttons|container|content|form|global|group|icons|inner|items?|left|links?|list|main|outer|panel|posts?|primary|right|secondary|section|site|slot|social|stories|the|top|unit|wrap|wrapper", re.I)
PAGE = frozenset("html body main".split())  # never set aside by class, id or role
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'/]++|\"[^\"]*+\"|'[^']*+'|[\"']|/(?!>))*+)(/?)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


ENDS = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
DIGITS = re.compile(r"[0-9]+")
DEEPEST = 200  # elements nested deeper are read as if they closed at once; their text keeps its place


def set_aside(names: str) -> bool:
    """Whether one of the names is made of words that set aside, and of words that may stand beside them."""
    for name in names.split():
        parts = [p for p in re.split("[_-]+", name)]
        if any(MARK.fullmatch(p) for p in parts) and all(MARK.fullmatch(p) or BESIDE.fullmatch(p) for p in parts):
            return True
    return False


@dataclass
class Node:
    tag: str
    label: str = ""  # tag and class, which alignment compares
    aside: bool = False  # by class, id or role
    hidden: bool = False
    children: list = field(default_factory=list)  # Nodes and Blocks


@dataclass
class Block:
    text: str
    linked: bool = False  # all of it inside links
    template: bool = False


def parse(html: str) -> Node:
    """A tree in which inline markup is dissolved into the text blocks of block elements."""
    root = Node("#root", "#root")
    stack, in_link = [root], False  # open block elements
    text: list[str] = []
    links = [0, 0]  # characters inside and outside links

    def end_block():
        joined = " ".join("".join(text).split())
        if joined:
            stack[-1].children.append(Block(joined, links[0] > 0 and not links[1]))
        text.clear()
        links[:] = 0, 0

    def add(raw: str):
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            text.append(raw)
            if not raw.isspace():
                links[0 if in_link else 1] += 1

    def close(at: int):
        end_block()
        del stack[at:]

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCKS or name in NEVER:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name:
                        close(i)
                        in_link = in_link and name == "p"
                        break
            elif name == "a":
                in_link = False
            continue
        if name in RAW:
            done = ENDS[name].search(html, at)
            at = html.find(">", done.end()) + 1 if done else 0
            if not at:
                break
            continue
        if name not in BLOCKS and name not in NEVER:
            if name in ("br", "wbr", "img"):
                text.append(" " if name != "wbr" else "")
            elif name == "a" and not m[4]:
                in_link = True
            continue
        end_block()
        if name in BLOCKS and stack[-1].tag == "p":
            close(len(stack) - 1)
            in_link = False
        if name in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in HOLDS[name]:
                    break
                if stack[i].tag in CLOSES[name]:
                    close(i)
        if name in VOID:
            continue
        node = Node(name, name)
        if m[3]:
            found = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(m[3])}
            marks = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            if name not in PAGE:
                node.label = " ".join([name, *DIGITS.sub("0", found.get("class", "")).split()])
            node.aside = name not in PAGE and set_aside(marks)
            node.hidden = "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
        if name == "main" and not any(x.tag in NEVER or x.hidden for x in stack):
            for x in stack:
                x.aside = False  # what holds the main part is no part beside it
        stack[-1].children.append(node)
        if len(stack) < DEEPEST and (not m[4] or name in BLOCKS):
            stack.append(node)
    end_block()
    return root


@dataclass
class Slot:
    """A node of a folded tree: neighbours of one shape. Of a page, with the nodes it stands for; of a
    wrapper, with a number."""

    label: str
    kids: list = field(default_factory=list)
    members: list = field(default_factory=list)
    number: int = -1
    shape: int = 0
    weight: int = 1

    def seal(self) -> None:
        """Shape and number of slots, those of the kids being known."""
        self.shape = hash((self.label, *(k.shape for k in self.kids)))
        self.weight = 1 + sum(k.weight for k in self.kids)


TEXT_SLOT = "#text"


def folded(root: Node) -> Slot:
    """The folded tree of a page: elements without text go, equal neighbours become one slot."""

    def shaped(x) -> Slot | None:
        if isinstance(x, Block):
            out = Slot(TEXT_SLOT, members=[x])
        else:
            out = Slot(x.label, members=[x])
            for c in x.children:
                k = shaped(c)
                if k is None:
                    continue
                if out.kids and out.kids[-1].shape == k.shape:
                    join(out.kids[-1], k)
                else:
                    out.kids.append(k)
            if not out.kids and x is not root:
                return None
        out.seal()
        return out

    def join(into: Slot, more: Slot) -> None:
        into.members += more.members
        for a, b in zip(into.kids, more.kids):
            join(a, b)

    return shaped(root)


class Matching:
    """Simple tree matching of folded trees."""

    MOST = 100_000  # pairs of unequal subtrees that are compared in full

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}
        self.left = self.MOST

    def score(self, a: Slot, b: Slot) -> int:
        """The size of the largest matching of a and b that keeps order."""
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.weight
        key = (a.shape, b.shape)
        if key not in self.known:
            if self.left <= 0:
                return 1
            self.left -= 1
            self.known[key] = 1 + sum(s for _, _, s in self.best(a.kids, b.kids))
        return self.known[key]

    def best(self, xs: list, ys: list) -> list[tuple[int, int, int]]:
        """Pairs (i, j, score) of the heaviest order-keeping matching of two child lists, in order. Equal
        beginnings and ends are matched at once, the last of both before the beginnings take it."""
        lo, hi_x, hi_y = 0, len(xs), len(ys)
        out, tail = [], []
        if hi_x > 1 and hi_y > 1 and xs[-1].shape == ys[-1].shape:
            hi_x, hi_y = hi_x - 1, hi_y - 1
            tail.append((hi_x, hi_y, xs[hi_x].weight))
        while lo < min(hi_x, hi_y) and xs[lo].shape == ys[lo].shape:
            out.append((lo, lo, xs[lo].weight))
            lo += 1
        while hi_x > lo and hi_y > lo and xs[hi_x - 1].shape == ys[hi_y - 1].shape:
            hi_x, hi_y = hi_x - 1, hi_y - 1
            tail.append((hi_x, hi_y, xs[hi_x].weight))
        if hi_x > lo and hi_y > lo:
            kinds_x, at_x = kinds(xs[lo:hi_x])
            kinds_y, at_y = kinds(ys[lo:hi_y])
            pair = np.array([[self.score(a, b) for b in kinds_y] for a in kinds_x])
            out += [(lo + i, lo + j, s) for i, j, s in heaviest(pair, at_x, at_y)]
        return out + tail[::-1]

    def align(self, a: Slot, b: Slot) -> list[tuple[Slot, Slot]]:
        """Matched slots of two trees whose roots match, from the roots downwards."""
        out, at = [(a, b)], 0
        while at < len(out):
            x, y = out[at]
            out += [(x.kids[i], y.kids[j]) for i, j, _ in self.best(x.kids, y.kids)]
            at += 1
        return out


def kinds(slots: list[Slot]) -> tuple[list[Slot], np.ndarray]:
    """One slot of each shape, and which of them each slot is."""
    place: dict[int, int] = {}
    at = np.array([place.setdefault(s.shape, len(place)) for s in slots])
    first: dict[int, Slot] = {}
    for s in slots:
        first.setdefault(s.shape, s)
    return list(first.values()), at


def reach(pair: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of all beginnings of y, the weight of the heaviest matching of it with x."""
    row = np.zeros(len(y) + 1, np.int64)
    for i in x:
        row[1:] = np.maximum(row[1:], row[:-1] + pair[i][y])
        np.maximum.accumulate(row, out=row)
    return row


def heaviest(pair: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """The heaviest order-keeping matching of two lists of kinds, with a weight for each pair of kinds.
    Halves x until a table is small (Hirschberg), so that memory is linear in the lists' lengths."""
    out: list[tuple[int, int, int]] = []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        x0, x1, y0, y1 = todo.pop()
        if x1 == x0 or y1 == y0:
            continue
        if (x1 - x0) * (y1 - y0) > 1 << 20 and x1 - x0 > 1:
            middle = (x0 + x1) // 2
            front = reach(pair, x[x0:middle], y[y0:y1])
            back = reach(pair, x[middle:x1][::-1], y[y0:y1][::-1])[::-1]
            cut = y0 + int(np.argmax(front + back))
            todo += [(middle, x1, cut, y1), (x0, middle, y0, cut)]
            continue
        table = np.zeros((x1 - x0 + 1, y1 - y0 + 1), np.int64)
        for i in range(x1 - x0):
            table[i + 1, 1:] = np.maximum(table[i, 1:], table[i, :-1] + pair[x[x0 + i]][y[y0:y1]])
            np.maximum.accumulate(table[i + 1], out=table[i + 1])
        i, j, found = x1 - x0, y1 - y0, []
        while i and j:
            here = table[i, j]
            if here == table[i - 1, j]:
                i -= 1
            elif here == table[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                found.append((x0 + i, y0 + j, int(pair[x[x0 + i], y[y0 + j]])))
        out += reversed(found)
    return out


def blocks(root) -> list[Block]:
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, Block):
            out.append(x)
        else:
            todo.extend(reversed(x.children))
    return out


# wrappers


def merged(wrapper: Slot, page: Slot, matching: Matching) -> Slot:
    """A wrapper with what a page adds: matched slots are one, others keep their place between them."""
    out, i, j = Slot(wrapper.label), 0, 0
    for a, b, _ in [*matching.best(wrapper.kids, page.kids), (len(wrapper.kids), len(page.kids), 0)]:
        out.kids += wrapper.kids[i:a] + [bare(k) for k in page.kids[j:b]]
        if a < len(wrapper.kids):
            out.kids.append(merged(wrapper.kids[a], page.kids[b], matching))
        i, j = a + 1, b + 1
    out.seal()
    return out


def bare(page: Slot) -> Slot:
    out = Slot(page.label, [bare(k) for k in page.kids])
    out.seal()
    return out


@dataclass
class Union:
    """A wrapper, and the trees it holds."""

    tree: Slot
    largest: int  # slots of its largest page
    pages: int
    keys: list[int]  # of the trees


def unions(trees: Iterable[tuple[list, int, int, int]], most_slots: int) -> Iterator[Union]:
    """Wrappers that together hold every tree of (tree, largest, pages, key), those of larger pages last. A
    tree with which the last wrapper would have too many slots begins the next."""
    now = None
    for raw, largest, pages, key in trees:
        tree, matching = loads(raw, []), Matching()
        if now is not None and (now.largest > most_slots) == (largest > most_slots):
            held = matching.score(now.tree, tree) == tree.weight
            more = now.tree if held else merged(now.tree, tree, matching)
            most = max(now.largest, largest)
            if held or more.weight <= max(most_slots, 2 * most if most > most_slots else 0):
                now.tree, now.largest, now.pages = more, most, now.pages + pages
                now.keys.append(key)
                continue
        if now is not None:
            yield now
        now = Union(tree, largest, pages, [key])
    if now is not None:
        yield now


def dumps(wrapper: Slot) -> list:
    return [wrapper.label, *(dumps(k) for k in wrapper.kids)]


def loads(raw: list, by_number: list[Slot]) -> Slot:
    out = Slot(raw[0], number=len(by_number))
    by_number.append(out)
    out.kids = [loads(k, by_number) for k in raw[1:]]
    out.seal()
    return out


@dataclass
class Seen:
    """What a wrapper's slot holds over the host's pages."""

    pages: int = 0
    chars: int = 0
    plain: int = 0  # outside links and elements that are never an article's text
    fixed: int = 0  # in texts that recur
    blocks: int = 0

    @property
    def varying(self) -> float:
        return max(0, self.plain - self.fixed) / self.pages if self.pages else 0.0


TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())


def content(x: Slot, seen: dict[int, Seen]) -> list[int]:
    """Numbers of the slots that hold the host's articles, from slot x downwards."""
    none = Seen()
    kids = [(k, seen.get(k.number, none)) for k in x.kids]
    kids = [(k, s) for k, s in kids if s.chars]
    most = max((s.varying for _, s in kids), default=0.0)
    if not most or x.label.split(" ")[0] in ("article", "main") or any(k.label.split(" ")[0] == "h1" for k, _ in kids):
        return [x.number]
    major = [(k, s) for k, s in kids if s.varying >= 0.5 * most]
    beside = [s for k, s in kids if s.varying < 0.5 * most and s.varying * s.pages < 0.5 * s.chars]
    if len(kids) > 1 and not any(2 * s.pages >= seen[x.number].pages for s in beside):
        return [x.number]  # nothing but text: this is the article
    if sum(s.pages for _, s in major) > 1.2 * seen[x.number].pages or any(all(g.label == TEXT_SLOT for g in k.kids) for k, _ in major):
        return [x.number]  # its parts stand on one page, or are its paragraphs
    return [n for k, _ in major for n in content(k, seen)]


def link_lists(wrapper: list[Slot], seen: dict[int, Seen], least_pages: int) -> list[int]:
    """Slots that are lists of links throughout the host."""
    out = []
    for x in wrapper:
        s = seen.get(x.number)
        if s and x.label.split(" ")[0] not in TITLES | {TEXT_SLOT} and s.pages >= least_pages and not s.plain and s.blocks >= 2 * s.pages:
            out.append(x.number)
    return out


# one page


def kept(node: Node, marked: bool = False, template: bool = False) -> list[Block]:
    """Blocks below a node that may be an article's text. marked: with what class, id or role set aside;
    template: with template blocks."""
    out: list[Block] = []

    def visit(x: Node, in_article: bool):
        inside = in_article or x.tag in ("article", "main")
        own = [c for c in x.children if isinstance(c, Node) and c.tag in ("li", "td", "dd")]
        if x.tag in ("ul", "ol", "table", "tr", "dl") and len(own) > 1 and all(b.linked for b in blocks(x)):
            return
        for c in x.children:
            if isinstance(c, Block):
                if template or not c.template:
                    out.append(c)
            elif not (c.tag in NEVER or c.hidden or c.aside and not marked or c.tag == "header" and not inside):
                visit(c, inside)

    visit(node, node.tag in ("article", "main"))
    return out


def articles(root: Node) -> list[Node]:
    """Outermost article elements, or else main ones, that stand in nothing set aside; an article is
    set aside by its own class, id or role only if there is another without."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "marked": []}
    todo = [root]
    while todo:
        x = todo.pop()
        for c in reversed(x.children):
            if isinstance(c, Node) and c.tag not in NEVER and not c.hidden:
                if c.tag == "article":
                    found["marked" if c.aside else "article"].append(c)
                elif c.tag == "main":
                    found["main"].append(c)
                if c.tag != "article" and not c.aside:
                    todo.append(c)
    if not found["article"]:
        for x in found["marked"]:
            x.aside = False
    mains = [m for m in found["main"] if kept(m, template=True)]
    some = {id(x) for x in found["article"] or mains or found["marked"]}
    return outermost(root, some)


def outermost(root: Node, some: set[int]) -> list[Node]:
    """The nodes with these ids in order, without those inside others."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        if id(x) in some:
            out.append(x)
        else:
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
    return out


def main_text(root: Node, regions: list[Node] | None = None) -> str:
    """The text of all articles within the regions, or of the regions if there are none, or of articles
    elsewhere. Where class, id or role set aside all there is, they are not looked at."""
    marked = articles(root)
    parts = marked or [root]
    if regions:
        some = {id(x) for x in regions}
        regions = outermost(root, some)
        below = {id(x) for r in regions for x in elements(r)}
        inside = [m for m in marked if id(m) in below]
        parts = inside or marked or regions
    for tried in (parts, marked, [root]):
        if tried and (text := text_of(tried, root)):
            return text
    return ""


def elements(root: Node) -> list[Node]:
    out = [root]
    for x in out:
        out += [c for c in x.children if isinstance(c, Node)]
    return out


def text_of(parts: list[Node], root: Node) -> str:
    marked = not any(kept(p, template=True) for p in parts)
    if marked and parts != [root]:
        parts = [p for p in parts if kept(p, marked=True, template=True)] or [root]
        marked = not any(kept(p, template=True) for p in parts)
    return "\n".join(b.text for p in parts for b in kept(p, marked))


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
WRAPPER = pa.schema([("host", pa.string()), ("volume", pa.int32()), ("wrapper", pa.string())])
WRAPPER_DDL = "host string, volume int, wrapper string"
OUTLINE = pa.schema([("host", pa.string()), ("h", pa.int64()), ("layout", pa.int64()), ("shape", pa.int64()), ("largest", pa.int64()), ("tree", pa.string())])
OUTLINE_DDL = "host string, h long, layout long, shape long, largest long, tree string"
UNITED = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("volume", pa.int32()), ("largest", pa.int64()), ("n", pa.int64()), ("part", pa.int64()), ("tree", pa.string()), ("keys", pa.list_(pa.int64()))])
UNITED_DDL = "host string, layout long, volume int, largest long, n long, part long, tree string, keys array<long>"
SHOWN_DDL = "host string, volume int, longest long, page long, slots array<struct<slot: int, chars: long, plain: long, blocks: long>>, texts array<struct<slot: int, text: long, chars: long>>"
COUNTED = pa.list_(pa.struct([("slot", pa.int32()), ("chars", pa.int64()), ("plain", pa.int64()), ("blocks", pa.int64())]))
RECURRING = pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.int64()), ("chars", pa.int64())]))
SHOWN = pa.schema([("host", pa.string()), ("volume", pa.int32()), ("longest", pa.int64()), ("page", pa.int64()), ("slots", COUNTED), ("texts", RECURRING)])
# Elements whose order of first appearance stands for a page's layout when trees are grouped.
PARTS = frozenset("article aside blockquote center div dl footer form h1 h2 header main nav ol pre section table ul".split())
SALTS = 16
BROADCAST_BYTES = 64 << 20


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) >> 1


class Wrappers:
    """Wrappers met lately, by their stored form."""

    def __init__(self):
        self.known: dict[str, tuple] = {}

    def get(self, stored: str) -> tuple:
        """(root, slots by number, content, link lists, recurring texts by slot)"""
        if stored not in self.known:
            if len(self.known) >= 256:
                self.known.clear()
            raw, by_number = json.loads(stored), []
            root = loads(raw["tree"], by_number)
            fixed = defaultdict(set)
            for slot, text in raw.get("fixed", ()):
                fixed[slot].add(text)
            self.known[stored] = root, by_number, set(raw.get("content", ())), set(raw.get("links", ())), fixed
        return self.known[stored]


def with_wrapper(rows: DataFrame, wrappers: DataFrame, further: DataFrame, how: str) -> DataFrame:
    """Rows joined with the wrapper of their host, of the volume `further` has for them or else the first:
    broadcast if all wrappers are small together, else salted, so that a host's pages meet it in several
    tasks."""
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    further = further.select(F.col("host").alias("in"), "h", "volume")
    rows = rows.join(further, (F.col("host") == F.col("in")) & (F.xxhash64("html") == F.col("h")), "left").drop("in", "h")
    rows = rows.withColumn("volume", F.coalesce("volume", F.lit(0)))
    wrappers = wrappers.select(F.col("host").alias("of"), F.col("volume").alias("of_volume"), "wrapper")
    same = (F.col("host") == F.col("of")) & (F.col("volume") == F.col("of_volume"))
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(wrappers), same, how)
    wrappers = wrappers.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int"))
    return rows.join(wrappers, same & (F.col("salt") == F.col("of_salt")), how)


def layout_of(tree: list) -> int:
    names, todo = {}, [tree]
    while todo:
        label, *kids = todo.pop()
        names.setdefault(label.split(" ")[0])
        todo.extend(reversed(kids))
    return text_key(" ".join(n for n in names if n in PARTS))


def outlines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of OUTLINE from (host, h, html); a tree goes with the first page of the task that has it."""
    known: dict[str, tuple[int, int]] = {}
    sent: set[tuple[str, int]] = set()
    for batch in batches:
        out = []
        for host, h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            page = folded(parse(html.as_py()))
            if not page.kids:
                continue
            raw = dumps(page)
            tree = json.dumps(raw)
            if tree not in known:
                if len(known) >= 1024:
                    known.clear()
                known[tree] = layout_of(raw), text_key(tree)
            layout, shape = known[tree]
            new = (host, shape) not in sent
            if new:
                if len(sent) >= 100_000:
                    sent.clear()
                sent.add((host, shape))
            out.append((host, h, layout, shape, page.weight, tree if new else None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), OUTLINE)], schema=OUTLINE)


def united(rows: DataFrame, most_slots: int) -> DataFrame:
    """The unions of each run of rows (host, layout, salt, tree, largest, n, key) with equal first three."""

    def run(batches):
        each = (r for batch in batches for r in zip(*batch.columns))
        for (host, layout, _), group in groupby(each, key=lambda r: tuple(x.as_py() for x in r[:3])):
            trees = ((json.loads(r[3].as_py()), *(x.as_py() for x in r[4:7])) for r in group)
            for volume, u in enumerate(unions(trees, most_slots)):
                tree = json.dumps(dumps(u.tree))
                row = host, layout, volume, u.largest, u.pages, text_key(tree), tree, u.keys
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, UNITED)], schema=UNITED)

    return rows.mapInArrow(run, UNITED_DDL)


def shown(html: str, host: str, volume: int, wrapper: Slot) -> tuple | None:
    """The row of SHOWN of a page."""
    page = parse(html)
    every = blocks(page)
    if not every:
        return None
    plain = {id(b) for b in kept(page, template=True) if not b.linked}
    slots, texts = [], {}
    for x, w in Matching().align(folded(page), wrapper):
        own = [b for m in x.members for b in blocks(m)]
        slots.append({"slot": w.number, "chars": sum(len(b.text) for b in own), "plain": sum(len(b.text) for b in own if id(b) in plain), "blocks": len(own)})
        if w.label == TEXT_SLOT:
            texts.update(((w.number, text_key(b.text)), len(b.text)) for b in own)
    longest = text_key(max((b.text for b in every), key=len))
    return host, volume, longest, text_key(html), slots, [{"slot": s, "text": t, "chars": n} for (s, t), n in texts.items()]


def judged(wrapper: str, slots: list[dict], texts: list[dict], volume: int, least_pages: int) -> str | None:
    """A wrapper with what its slots are; none if it has too few pages to tell."""
    raw, by_number = json.loads(wrapper), []
    root = loads(raw["tree"], by_number)
    seen = {s["slot"]: Seen(s["pages"], s["chars"], s["plain"], 0, s["blocks"]) for s in slots or ()}
    above: dict[int, int] = {}
    for x in by_number:
        above.update((k.number, x.number) for k in x.kids)
    for t in texts or ():
        at = t["slot"]
        while True:
            seen[at].fixed += t["chars"]
            if at not in above:
                break
            at = above[at]
    if not seen or seen[root.number].pages < (max(2, least_pages) if volume else 2):
        return None
    raw |= {"content": content(root, seen), "links": link_lists(by_number, seen, least_pages), "fixed": [[t["slot"], t["text"]] for t in texts or ()]}
    return json.dumps(raw)


def induce(rows: DataFrame, references: int, most_slots: int, share: float, least_pages: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(host, volume, wrapper) of hosts with two or more pages, from rows (host, html) with both, and
    (host, h, volume) of the pages that are not of the first volume, by the hash of their html."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism  # merging is long for few bytes
    outlined = scratch.keep(rows.select("host", F.xxhash64("html").alias("h"), "html").mapInArrow(outlines, OUTLINE_DDL))
    trees = outlined.groupBy("host", "layout", "shape").agg(F.count("*").alias("n"), F.min("largest").alias("largest"), F.min("tree").alias("tree"))
    trees = trees.withColumn("salt", F.pmod("shape", F.lit(references)))
    trees = trees.repartition(tasks, "host", "layout", "salt").sortWithinPartitions("host", "layout", "salt", F.col("largest") > most_slots, F.desc("n"), "shape")
    parts = scratch.keep(united(trees.select("host", "layout", "salt", "tree", "largest", "n", "shape"), most_slots))
    ranked = parts.withColumn("of_layout", F.sum("n").over(Window.partitionBy("host", "layout"))).repartition(tasks, "host")
    ranked = ranked.sortWithinPartitions("host", F.col("largest") > most_slots, F.desc("of_layout"), "layout", F.desc("n"), "part")
    whole = scratch.keep(united(ranked.select("host", F.lit(0).cast("long").alias("layout"), F.lit(0).alias("salt"), "tree", "largest", "n", "part"), most_slots).where("n > 1"))
    of_part = whole.where("volume > 0").select("host", "volume", F.explode("keys").alias("part"))
    of_shape = of_part.join(parts.select("host", "part", F.explode("keys").alias("shape")), ["host", "part"])
    further = scratch.keep(outlined.join(of_shape, ["host", "shape"]).groupBy("host", "h").agg(F.min("volume").alias("volume")))
    wrappers = scratch.keep(whole.select("host", "volume", F.concat(F.lit('{"tree": '), "tree", F.lit("}")).alias("wrapper")))
    scratch.drop(outlined, parts, whole)

    def compare(batches):
        met = Wrappers()
        for batch in batches:
            out = [shown(html.as_py(), host, volume, met.get(stored)[0]) for html, host, volume, stored in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]))]
            out = [x for x in out if x]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), SHOWN)], schema=SHOWN)

    of = ["host", "volume"]
    pages = with_wrapper(rows, wrappers, further, "inner").select("html", *of, "wrapper").mapInArrow(compare, SHOWN_DDL)
    once = scratch.keep(pages.groupBy(*of, "longest").agg(F.min_by(F.struct("slots", "texts"), "page").alias("s")).select(*of, "s.*"))
    slots = once.select(*of, F.explode("slots").alias("x")).select(*of, "x.*").groupBy(*of, "slot")
    slots = scratch.keep(slots.agg(F.count("*").alias("pages"), *(F.sum(c).alias(c) for c in ("chars", "plain", "blocks"))))
    texts = once.select(*of, F.explode("texts").alias("x")).select(*of, "x.*").groupBy(*of, "slot", "text").agg(F.count("*").alias("n"), F.sum("chars").alias("fixed_chars")).where(F.col("n") >= least_pages)
    # at most 1 / share texts of a page's length for each slot
    fixed = texts.join(slots.select(*of, "slot", "pages"), [*of, "slot"]).where(F.col("n") >= share * F.col("pages"))
    fixed = fixed.groupBy(*of).agg(F.collect_list(F.struct("slot", "text", F.col("fixed_chars").alias("chars"))).alias("texts"))
    facts = slots.groupBy(*of).agg(F.collect_list(F.struct("slot", "pages", "chars", "plain", "blocks")).alias("slots"))

    def judge(batches):
        for batch in batches:
            hosts, volumes, *columns = (c.to_pylist() for c in batch.columns)
            out = [judged(*x, volume, least_pages) for volume, *x in zip(volumes, *columns)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((hosts, volumes, out), WRAPPER)], schema=WRAPPER)

    all_facts = wrappers.join(facts, of, "left").join(fixed, of, "left").select(*of, "wrapper", "slots", "texts")
    known = scratch.keep(all_facts.mapInArrow(judge, WRAPPER_DDL).where("wrapper IS NOT NULL"))
    return known, further.join(known.select(*of), of, "left_semi")


def read_page(html: str, wrapper: tuple | None) -> str:
    page = parse(html)
    if wrapper is None:
        return main_text(page)
    root, _, content_slots, links, fixed = wrapper
    regions = []
    for x, w in Matching().align(folded(page), root):
        if w.number in content_slots:
            regions += [m for m in x.members if isinstance(m, Node)]
        if w.number in links:
            for m in x.members:
                m.hidden = True
        if w.number in fixed:
            for b in x.members:
                b.template = text_key(b.text) in fixed[w.number]
    return main_text(page, regions)


def extract(pages: DataFrame, references: int = 6, share: float = 0.5, least_pages: int = 3, most_slots: int = 4000) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages.

    A text is template in a slot if at least `least_pages` pages with the slot (copies once) and at least
    that share of them have it there.
    """
    scratch = Scratch(pages.sparkSession, "wrapper")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    rows = rows.withColumn("host", F.nullif(host_of("url"), F.lit("")))
    known = rows.where("host IS NOT NULL AND html <> ''").select("host", "html")
    wrappers, further = induce(known, references, most_slots, share, least_pages, scratch)

    def read(batches):
        met = Wrappers()
        for batch in batches:
            out = []
            for page_id, url, html, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                html = html.as_py()
                text = read_page(html, stored and met.get(stored)) if html else ""
                out.append((page_id, url, text, len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), TEXT)], schema=TEXT)

    return with_wrapper(rows, wrappers, further, "left").select("page_id", "url", "html", "wrapper").mapInArrow(read, "page_id long, url string, text string, n_chars long")

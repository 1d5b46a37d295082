"""Main-text extraction by wrappers, inferred as union-free regular expressions.

Pages of one host come from a few templates. Their token streams are aligned one after the other: text that differs becomes a slot,
elements that only some pages have become optional, and runs of like elements become repeated groups. What an element of the wrapper
holds over all pages (text that varies, text that is alike, links) decides which region is the article and which of its parts are
template text. Every page of the host is then matched against the expression, and the text in the slots that are left is its article.

Tags and roles say what is no article by the HTML standard. Words of a class or id are hints only: an element with such a word goes,
unless it holds nearly all of the text beside it or a heading that varies from page to page.

Scale: every distinct page of a host counts, once. Pages are dealt by host and content, so the pages of a hot host meet in no single
task; each task unites its pages into a wrapper for each layout (the page's nest of containers) and one for the host, and what the tasks
found is united again by host and layout. Pages are then extracted in a map, each by the wrapper of its layout. Wrappers are broadcast up
to ``broadcast_bytes``, which is checked, and joined by host and layout beyond.
"""

from __future__ import annotations

import html
import json
import re
import sys
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .urls import split_url

BROADCAST_BYTES = 16 << 20
#: Text within the article counts as the template's only if it is alike in so many pages.
LEAST_PAGES = 6
#: Layouts of one host that a task holds at a time.
MOST_LAYOUTS = 1000
#: Children of two elements are aligned exactly up to this product of their numbers, and may come in any order beyond.
MOST_CELLS = 1_000_000
#: Python calls that a page may nest: its elements may be open so deep. Such calls take no space on the machine's own stack.
DEPTH = 1_000_000
#: An element hinted at by its class or id stays if the text beside it is less than this share of its own.
BESIDE = 0.2

#: Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea svg math iframe object canvas audio video select title".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = {"td", "th"}
#: An open element of the first kind ends where one of the second begins.
CLOSED_BY = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}, "head": {"body"}}
CLOSES = {t: [x for x, by in CLOSED_BY.items() if t in by] for t in set().union(*CLOSED_BY.values())}
LAYOUT = set("body div section main article table".split())
CONTAINERS = set("html body div section main article table tbody tr td center span".split())
NOT_TEXT = set("nav footer aside form button head dialog menu label input".split()) | RAW
NOT_TEXT_ROLES = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
#: Words of a class or id that hint at an element which is no part of the article.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo "
    "promoted promotion related recommended reply replies respond share sharing sidebar signup social sponsor sponsored sponsor skip subscribe "
    "subscription tags toolbar topbar trending widget widgets alert overlay copyright".split()
)

HEADINGS = {"h1", "h2", "h3"}
#: Elements that keep what is open around them from being closed by what begins inside.
BARRIERS = {"table", "ul", "ol", "div", "article", "section", "dl"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element; children are nodes and strings of text. holds: whether a block or an element that is no text lies within."""

    __slots__ = ("children", "hinted", "holds", "junk", "sig", "tag")

    def __init__(self, tag: str, sig: str, junk: bool, hinted: bool):
        self.tag, self.sig, self.junk, self.hinted, self.holds, self.children = tag, sig, junk, hinted, False, []

    @property
    def structural(self) -> bool:
        """Whether it is a block, holds one, or is no text; all else is part of its block's text."""
        return self.holds or self.junk or self.hinted or self.tag in CELLS or (self.tag in BLOCK and self.tag != "br")


def _element(tag: str, raw: str) -> Node:
    found = dict((k.lower(), v.strip("\"'")) for k, v in _ATTRIBUTE.findall(raw)) if " " in raw or "\n" in raw else {}
    names = f"{found.get('class', '')} {found.get('id', '')}" if found else ""
    hidden = "hidden" in found.get("aria-hidden", "").replace("true", "hidden") or "display:none" in found.get("style", "").replace(" ", "")
    junk = tag in NOT_TEXT or hidden or found.get("role", "").lower() in NOT_TEXT_ROLES
    hinted = tag not in ("body", "html", "article", "main") and not HINTS.isdisjoint(w.lower() for w in _WORD.findall(names))
    role = ".main" if found.get("role") == "main" or found.get("itemprop") == "articleBody" else ""
    marks = sorted(set(re.sub(r"\d+", "0", names).split())) if names else ()
    return Node(tag, tag + role + "".join(f".{m}" for m in marks), junk, hinted)


def parse(text: str) -> Node:
    """A lenient tree of any depth: unclosed elements end with their parents, stray end tags are ignored, raw elements lose their content."""
    root = Node("#root", "#root", False, False)
    stack, at, end = [root], 0, len(text)
    open_tags: dict[str, int] = {}

    def cut(i: int) -> None:
        for x in stack[i:]:
            open_tags[x.tag] -= 1
        del stack[i:]

    while at < end:
        m = _TOKEN.search(text, at)
        if m is None:
            stack[-1].children.append(text[at:])
            break
        if m.start() > at:
            stack[-1].children.append(text[at : m.start()])
        at, raw = m.end(), m.group()
        name = _NAME.match(raw)
        if raw[1] in "!?" or name is None:
            continue
        tag = name.group(1).lower()
        if raw[1] == "/":
            if open_tags.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                cut(i)
            continue
        i = len(stack) - 1 if any(open_tags.get(x) for x in CLOSES.get(tag, ())) else 0
        while i > 0:
            if tag in CLOSED_BY.get(stack[i].tag, ()):
                cut(i)
            elif stack[i].tag in BARRIERS:
                break
            i -= 1
        node = _element(tag, raw)
        if tag == "header" and not (open_tags.get("article") or open_tags.get("main")):
            node.junk = True  # the page's header, not an article's
        stack[-1].children.append(node)
        if node.structural:
            for x in reversed(stack):
                if x.holds:
                    break
                x.holds = True
        if tag in RAW and not raw.endswith("/>"):
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(text, at)
            at = close.end() if close else end
        elif tag not in VOID and not raw.endswith("/>"):
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


def _pieces(node: Node, out: list[str | None]) -> None:
    """The text of an element without structure, character references decoded piece by piece; None for a line break."""
    if node.tag == "br":
        out.append(None)
    for c in node.children:
        if isinstance(c, str):
            out.append(html.unescape(c) if "&" in c else c)
        else:
            _pieces(c, out)


class Slot:
    """Text with its inline markup: a leaf of a page."""

    __slots__ = ("linked", "pieces", "sig")

    def __init__(self, pieces: list[str | None], linked: int):
        self.pieces, self.linked, self.sig = pieces, linked, "#"

    @property
    def text(self) -> str:
        return " ".join("".join(" " if x is None else x for x in self.pieces).split())


def leaves(node: Node) -> list[Node | Slot]:
    """The children of an element as the wrapper sees them: structural elements, and the text between them as slots."""
    out: list[Node | Slot] = []
    pieces: list[str | None] = []
    linked = 0
    for child in [*node.children, None]:
        if isinstance(child, str):
            pieces.append(html.unescape(child) if "&" in child else child)
        elif child is None or child.structural:
            if any(x is None or x.strip() for x in pieces):
                out.append(Slot(pieces, linked))
            pieces, linked = [], 0
            if child is not None:
                out.append(child)
        else:
            before = len(pieces)
            _pieces(child, pieces)
            linked += sum(len(x or "") for x in pieces[before:]) if child.tag == "a" else 0
    return out


class Part:
    """A piece of a wrapper: an element, a text slot (#) or a group of several (the tag is empty), how often it occurs (1, ?, + or *),
    and what it held over all pages: characters, linked ones, and the text if it was always the same.

    drop, region and plain are decided at the end (``finished``): no text, the article, nothing decided within.
    """

    __slots__ = ("atoms", "children", "constant", "drop", "hinted", "junk", "link", "mass", "occurs", "pages", "plain", "region", "sig", "tag")

    def __init__(self, sig: str, tag: str, junk: bool = False, hinted: bool = False):
        self.sig, self.tag, self.junk, self.hinted, self.occurs, self.children = sig, tag, junk, hinted, "1", []
        self.constant, self.mass, self.link, self.pages = None, 0, 0, 1
        self.drop = self.region = False
        self.plain, self.atoms = True, None

    @property
    def prose(self) -> int:
        return self.mass - self.link


def part_of(node: Node) -> Part:
    """The wrapper of one page: text with inline markup is one slot, and like neighbours are folded into a repeated group."""
    made = Part(node.sig, node.tag, node.junk, node.hinted)
    for child in leaves(node):
        if isinstance(child, Node):
            part = part_of(child)
        else:
            part = Part("#", "#")
            part.constant = child.text
            part.mass, part.link = len(part.constant), child.linked
        _add(made, part)
    return made


def _group(parts: list[Part]) -> Part:
    made = Part("(" + " ".join(x.sig for x in parts) + ")", "")
    made.children = parts
    made.mass, made.link = sum(x.mass for x in parts if not x.junk), sum(x.link for x in parts if not x.junk)
    return made


def _add(made: Part, part: Part) -> None:
    """Append a child, folding repeats of one element, and of groups of two or three."""
    if not part.junk:
        made.mass += part.mass
        made.link += part.mass if part.tag == "a" else part.link
    row = made.children
    row.append(part)
    if part.sig == "#":
        return
    if len(row) > 1 and row[-2].sig == part.sig:
        row.pop()
        _again(row[-1], part)
        return
    for n in (2, 3):
        tail = row[-n:]
        if len(row) > n and row[-n - 1].tag == "" and [x.sig for x in row[-n - 1].children] == [x.sig for x in tail]:
            del row[-n:]
            _again(row[-1], _group(tail))
            return
        if len(row) >= 2 * n and [x.sig for x in row[-2 * n : -n]] == [x.sig for x in tail]:
            first = _group(row[-2 * n : -n])
            del row[-2 * n :]
            row.append(first)
            _again(first, _group(tail))
            return


def _again(part: Part, other: Part) -> None:
    """One more occurrence on the same page."""
    pages = part.pages
    _unite(part, other)
    part.occurs, part.pages = "*" if part.occurs in "?*" else "+", pages


def _joined(a: str, b: str) -> str:
    optional, repeated = a in "?*" or b in "?*", a in "+*" or b in "+*"
    return "*" if optional and repeated else "?" if optional else "+" if repeated else "1"


def _gathered(row: list[Part], other: list[Part]) -> list[Part]:
    """``row`` with elements put together that ``other`` has as one group."""
    for sigs in {tuple(x.sig for x in g.children) for g in other if g.tag == ""}:
        out: list[Part] = []
        for x in row:
            out.append(x)
            tail = out[-len(sigs) :]
            if tuple(y.sig for y in tail) == sigs and all(y.occurs == "1" for y in tail):
                out[-len(sigs) :] = [_group(tail)]
        row = out
    return row


def _unite(a: Part, b: Part) -> None:
    """Generalise ``a`` until it matches what ``b`` does."""
    a.occurs = _joined(a.occurs, b.occurs)
    a.mass, a.link, a.pages = a.mass + b.mass, a.link + b.link, a.pages + b.pages
    if a.constant != b.constant:
        a.constant = None
    x, y = a.children, b.children
    if len(x) == len(y) and all(p.sig == q.sig for p, q in zip(x, y, strict=True)):
        for p, q in zip(x, y, strict=True):
            _unite(p, q)
        return
    x, y = _gathered(x, y), _gathered(y, x)
    # What is alike at both ends needs no alignment.
    head = 0
    while head < min(len(x), len(y)) and x[head].sig == y[head].sig:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail].sig == y[-1 - tail].sig:
        tail += 1
    for p, q in [*zip(x[:head], y[:head], strict=True), *zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)]:
        _unite(p, q)
    a.children = [*x[:head], *_aligned(x[head : len(x) - tail], y[head : len(y) - tail]), *x[len(x) - tail :]]


def _aligned(x: list[Part], y: list[Part]) -> list[Part]:
    """Two rows as one: the longest common subsequence of signatures is united, all else is optional."""
    n, m = len(x), len(y)
    if n * m > MOST_CELLS:
        return [_any_order(x + y)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].sig == y[j].sig else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and x[i].sig == y[j].sig:
            _unite(x[i], y[j])
            out.append(x[i])
            i, j = i + 1, j + 1
            continue
        if j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            one, i = x[i], i + 1
        else:
            one, j = y[j], j + 1
        one.occurs = _joined(one.occurs, "?")
        out.append(one)
    return out


def _any_order(parts: list[Part]) -> Part:
    """A group that repeats, of the distinct elements of ``parts``, each of them optional."""
    first: dict[str, Part] = {}
    for x in parts:
        for child in x.children if x.tag == "" else [x]:
            if child.sig in first:
                _unite(first[child.sig], child)
            else:
                first[child.sig] = child
    for x in first.values():
        x.occurs = _joined(x.occurs, "?")
    made = _group(list(first.values()))
    made.sig, made.occurs = "(*)", "*"
    return made


def expression(part: Part) -> str:
    """The wrapper as a union-free regular expression over tags, fixed texts and slots (#)."""
    inner = "".join(expression(x) for x in part.children)
    if part.sig == "#":
        body = re.escape(part.constant) if part.constant is not None else "#"
    else:
        body = inner if part.tag == "" else f"<{part.sig}>{inner}</{part.tag}>"
    return body if part.occurs == "1" and part.tag else f"({body}){part.occurs if part.occurs != '1' else ''}"


def _within(part: Part) -> Iterator[Part]:
    """The children of an element, those of its groups in their place."""
    for child in part.children:
        if child.tag == "":
            yield from _within(child)
        else:
            yield child


def _title(part: Part) -> bool:
    """Whether a heading lies within that differs from page to page; of a single page, any first or second one may."""
    for child in _within(part):
        if child.sig == "#":
            continue
        if child.tag in HEADINGS and child.occurs in "1?" and not child.junk and any(x.sig == "#" and (x.constant is None or (x.pages == 1 and child.tag == "h1")) for x in _within(child)):
            return True
        if not child.junk and child.occurs in "1?" and _title(child):
            return True
    return False


def _settle(part: Part) -> None:
    """Decide, from the leaves up, which elements are no text, and count what the others hold."""
    if part.sig == "#":
        return
    for child in part.children:
        _settle(child)
    row = list(_within(part)) if part.tag else []
    certain = sum(x.prose for x in row if not x.hinted and not x.junk)
    for x in row:
        x.drop = x.junk or (x.hinted and certain >= BESIDE * x.prose and not _title(x))
    part.mass = sum(x.mass for x in part.children if not x.drop)
    part.link = sum(x.mass if x.tag == "a" else x.link for x in part.children if not x.drop)


def main_region(root: Part) -> Part:
    """The region with the article: a marked one if it holds enough text, else the narrowest that does."""
    marked: list[tuple] = []

    def walk(part: Part, depth: int) -> None:
        for child in _within(part):
            if child.drop or child.sig == "#":
                continue
            if child.tag in ("article", "main") or ".main" in child.sig:
                marked.append((child.prose, child.tag == "article" or ".main" in child.sig, depth, child))
            walk(child, depth + 1)

    walk(root, 1)
    if marked:
        most = max(x[0] for x in marked)
        close = [x for x in marked if x[0] >= 0.8 * most and x[0] > 0]
        if close and most >= 0.05 * root.prose:
            return max(close, key=lambda x: (x[1], x[2]))[3]
    part = root
    while True:
        inner = [x for x in _within(part) if not x.drop and x.tag in CONTAINERS]
        best = max(inner, key=lambda x: x.prose, default=None)
        if best is None or best.occurs in "+*" or best.prose < 0.7 * part.prose or best.prose == 0:
            return part
        part = best


def _template_slots(region: Part, pages: int) -> list[Part]:
    """Slots within the article that are the template's: the only text of a block, and alike on every page, of which there are enough.

    None if a heading or most of the article is alike on every page: the pages then are copies of one article.
    """
    found: list[Part] = []
    copies = False

    def walk(part: Part) -> None:
        nonlocal copies
        for child in _within(part):
            if child.drop or child.sig == "#":
                continue
            if child.tag in BLOCK and child.occurs == "1" and child.pages >= pages and len(child.children) == 1 and child.children[0].sig == "#":
                only = child.children[0]
                if only.constant is not None and only.occurs == "1" and only.pages >= pages:
                    found.append(only)
                    copies = copies or child.tag in HEADINGS
            walk(child)

    if pages >= LEAST_PAGES:
        walk(region)
    return [] if copies or 2 * sum(x.mass for x in found) > region.mass else found


class Wrapper:
    """A wrapper whose parts are decided, and the number of pages that it was inferred from."""

    def __init__(self, root: Part, pages: int):
        self.root, self.pages = root, pages

    @property
    def expression(self) -> str:
        return expression(self.root)

    @property
    def fixed(self) -> bool:
        """Whether text within the article is the template's."""
        return any(x.sig == "#" and x.drop for x in _all(self.root))

    def dumped(self) -> str:
        return json.dumps([self.pages, dumped(self.root)])

    @classmethod
    def loaded(cls, text: str) -> Wrapper:
        pages, root = json.loads(text)
        made = cls(loaded(root), pages)
        _mark(made.root)
        return made


def _all(part: Part) -> Iterator[Part]:
    todo = [part]
    while todo:
        x = todo.pop()
        yield x
        todo += x.children


def _mark(part: Part) -> None:
    """plain: nothing within is left out, and the article's region is not there."""
    for child in part.children:
        _mark(child)
    part.plain = all(x.plain and not x.drop and not x.region for x in part.children)


def finished(root: Part, pages: int) -> Wrapper:
    """The wrapper of ``pages`` united pages, its article and what is no text in it decided."""
    _settle(root)
    region = main_region(root)
    region.region = True
    for slot in _template_slots(region, pages):
        slot.drop = True
    for x in _all(root):
        if x.sig == "#" and not x.drop:
            x.constant = x.constant if pages > 1 and x.pages >= pages else None
    _mark(root)
    return Wrapper(root, pages)


def layout(root: Node) -> str:
    """A name of the page's layout: the paths of its containers, however often each occurs."""
    found: set[str] = set()

    def walk(node: Node, path: str) -> None:
        for child in node.children:
            if isinstance(child, Node) and child.holds and not child.junk and not child.hinted:
                here = path
                if child.tag in LAYOUT:
                    here = f"{path}/{child.sig}" if len(path) < 200 else md5(f"{path}/{child.sig}".encode()).hexdigest()
                    found.add(here)
                walk(child, here)

    walk(root, "")
    return md5("\n".join(sorted(found)).encode()).hexdigest()


def dumped(part: Part) -> list:
    """A wrapper as a list of rows: a part comes before its children, with their number."""
    out: list[list] = []

    def walk(x: Part) -> None:
        flags = x.junk | x.hinted << 1 | x.drop << 2 | x.region << 3
        out.append([x.sig, x.tag, flags, x.occurs, x.constant, x.mass, x.link, x.pages, len(x.children)])
        for child in x.children:
            walk(child)

    walk(part)
    return out


def loaded(rows: list) -> Part:
    given = iter(rows)

    def read() -> Part:
        sig, tag, flags, occurs, constant, mass, link, pages, n = next(given)
        made = Part(sig, tag, bool(flags & 1), bool(flags & 2))
        made.drop, made.region = bool(flags & 4), bool(flags & 8)
        made.occurs, made.constant, made.mass, made.link, made.pages = occurs, constant, mass, link, pages
        for _ in range(n):
            made.children.append(read())
        return made

    return read()


def infer(texts: list[str]) -> Wrapper:
    """The wrapper of distinct pages of one host."""
    root = None
    given = sorted(set(texts))
    for text in given:
        part = part_of(parse(text))
        if root is None:
            root = part
        else:
            _unite(root, part)
    return finished(root, len(given))


class _Atoms:
    """The elements and slots that a row of a page's children is matched against: a position automaton of the wrapper's row.

    From one position the row goes on to any later one up to the first that has to occur, again to the same one if it repeats, or to
    the start of a group that repeats.
    """

    def __init__(self, parts: list[Part]):
        self.parts: list[Part] = []
        self.loop: list[tuple[int, int] | None] = []
        needed: list[bool] = []
        self.where: dict[str, list[int]] = {}

        def put(row: list[Part], must: bool, loop: tuple[int, int] | None) -> None:
            for p in row:
                must_here = must and p.occurs in "1+"
                if p.tag == "":
                    begin = len(self.parts)
                    put(p.children, must_here, loop)
                    if p.occurs in "+*":
                        for k in range(begin, len(self.parts)):
                            self.loop[k] = (begin, len(self.parts))
                else:
                    self.where.setdefault(p.sig, []).append(len(self.parts))
                    self.parts.append(p)
                    self.loop.append(loop)
                    needed.append(must_here)

        put(parts, True, None)
        self.reach = [len(needed)] * (len(needed) + 1)
        for k in range(len(needed) - 1, -1, -1):
            self.reach[k] = k if needed[k] else self.reach[k + 1]

    def match(self, sigs: list[str]) -> list[Part | None]:
        """The part of each child of a page; None for one that the wrapper has nowhere."""
        alike = {s: self.parts[at[0]] for s, at in self.where.items() if len(at) == 1 or all(self.parts[k].plain and not self.parts[k].drop and not self.parts[k].region for k in at)}
        if all(s in alike or s not in self.where for s in sigs):
            return [alike.get(s) for s in sigs]
        states: dict[int, tuple | None] = {-1: None}  # position: the chain of positions before it
        done: list[dict[int, int]] = []
        for s in sigs:
            at = self.where.get(s, ())
            after: dict[int, int] = {}
            for k in states:
                for j in at[bisect_right(at, k) : bisect_right(at, self.reach[k + 1])]:
                    after.setdefault(j, k)
                loop = self.loop[k] if k >= 0 else None
                for j in at if loop else ():
                    if loop[0] <= j < loop[1]:
                        after.setdefault(j, k)
                if k >= 0 and self.parts[k].sig == s and self.parts[k].occurs in "+*":
                    after.setdefault(k, k)
            done.append(after)
            if after:
                states = dict.fromkeys(after)
        out: list[Part | None] = [None] * len(sigs)
        at = min(states)
        for i in range(len(sigs) - 1, -1, -1):
            if done[i]:
                out[i] = self.parts[at]
                at = done[i][at]
        return out


def _article(root: Node, wrapper: Wrapper, skipped: set[int] | None = None) -> tuple[list[str], bool]:
    """The blocks of a page by a wrapper, and whether its article is there. skipped: gets the ids of slots that are template text.

    Children that the wrapper has nowhere are text unless their tag or a hint speaks against it.
    """
    blocks: list[str] = []
    pieces: list[str] = []
    found = False

    def close() -> None:
        line = " ".join("".join(pieces).split())
        if line:
            blocks.append(line)
        pieces.clear()

    def walk(node: Node, part: Part | None, inside: bool) -> None:
        nonlocal found
        if part is not None and part.region:
            inside = found = True
        row = leaves(node)
        if part is not None and part.atoms is None:
            part.atoms = _Atoms(part.children)
        parts = part.atoms.match([x.sig for x in row]) if part is not None else [None] * len(row)
        for child, own in zip(row, parts, strict=True):
            if isinstance(child, Slot):
                if not inside or (own is not None and own.drop):
                    if skipped is not None and own is not None and own.drop:
                        skipped.add(id(node))
                    continue
                if skipped is None or id(node) not in skipped:
                    for x in child.pieces:
                        close() if x is None else pieces.append(x)
                continue
            block = child.tag in BLOCK
            if child.junk or (own.drop if own is not None else child.hinted):
                close() if block else None
                continue
            if block:
                close()
            elif child.tag in CELLS:
                pieces.append(" ")
            if inside or own is None or own.region or not own.plain:
                walk(child, own, inside)
            if block:
                close()

    walk(root, wrapper.root, False)
    close()
    return blocks, found


def extract(text: str, wrapper: Wrapper | None, whole: Wrapper | None = None) -> str:
    """The article's blocks, one a line; without a wrapper that fits, by the page's own."""
    return _extract(parse(text), wrapper, whole)


def _extract(root: Node, wrapper: Wrapper | None, whole: Wrapper | None = None) -> str:
    """The article of a page by the wrapper of its layout. whole: that of its host, whose template texts go as well."""
    skipped: set[int] = set()
    if whole is not None and whole.fixed:
        _article(root, whole, skipped)
    for one in (wrapper, whole):
        if one is not None:
            blocks, found = _article(root, one, skipped)
            if found:
                return "\n".join(blocks)
    return "\n".join(_article(root, finished(part_of(root), 1), skipped)[0])


def _prepared(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").alias("html"), split_url(F.col("url").cast("string"))[0].alias("host"))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, layout and wrapper (JSON, see ``Wrapper``) from all distinct pages (page_id, url, html) of each host.

    A layout that one page only has gets no wrapper, since a page alone tells as much by itself; the empty layout is the whole host.
    """
    given = _prepared(pages).where("html is not null and host is not null").select("host", F.md5(F.col("html").cast("binary")).alias("name"), "html")
    dealt = given.repartition("host", "name").sortWithinPartitions("host", "name")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        current, before, held = None, None, {}

        def rows() -> pa.RecordBatch:
            made = [(current, k, n, json.dumps(dumped(part))) for k, (n, part) in held.items()]
            found = [part for _, part in held.values()]
            for part in found[1:]:
                _unite(found[0], part)
            made.append((current, "", sum(n for n, _ in held.values()), json.dumps(dumped(found[0]))))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["host", "layout", "n", "part"])

        for batch in batches:
            for host, name, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (host != current or len(held) > MOST_LAYOUTS):
                    yield rows()
                if (host, name) == (current, before):
                    continue  # a copy
                current, before = host, name
                root = parse(text)
                key, part = layout(root), part_of(root)
                if key in held:
                    n, known = held[key]
                    _unite(known, part)
                    held[key] = (n + 1, known)
                else:
                    held[key] = (1, part)
        if held:
            yield rows()

    def whole(group):
        import pandas as pd

        sys.setrecursionlimit(DEPTH)
        root = None
        for text in sorted(group["part"]):
            part = loaded(json.loads(text))
            if root is None:
                root = part
            else:
                _unite(root, part)
        n = int(group["n"].sum())
        return pd.DataFrame({"host": [group["host"].iloc[0]], "layout": [group["layout"].iloc[0]], "wrapper": [finished(root, n).dumped()], "n": [n]})

    found = dealt.mapInArrow(partial, "host string, layout string, n long, part string")
    return found.groupBy("host", "layout").applyInPandas(whole, "host string, layout string, wrapper string, n long").where("n > 1 or layout = ''").drop("n")


def extract_pages(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null and empty html give an empty text. A page whose layout has no wrapper, or whose url has no host, is judged by itself.
    Unclosed tags end with their parents, and a page that breaks off is taken as far as it goes. Repeated rows each get their row.
    """
    wrappers = common.stored(infer_wrappers(pages))
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host") + 32)).first()[0] or 0
    prepared = _prepared(pages)
    schema = "page_id long, url string, text string, n_chars long"
    sent = None
    if size <= broadcast_bytes:
        sent = pages.sparkSession.sparkContext.broadcast({(r.host, r.layout): r.wrapper for r in wrappers.collect()})
        joined = prepared.select("page_id", "url", "html", "host", F.lit(None).cast("string").alias("wrapper"), F.lit(None).cast("string").alias("whole"))
    else:

        def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sys.setrecursionlimit(DEPTH)
            for batch in batches:
                yield batch.append_column("layout", pa.array([layout(parse(x or "")) for x in batch.column(2).to_pylist()], pa.string()))

        named = prepared.mapInArrow(laid, "page_id long, url string, html string, host string, layout string")
        hosts = wrappers.where("layout = ''").select("host", F.col("wrapper").alias("whole"))
        joined = named.join(wrappers.where("layout != ''"), ["host", "layout"], "left").join(hosts, "host", "left").select("page_id", "url", "html", "host", "wrapper", "whole")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(DEPTH)
        known: dict[str, Wrapper] = {}

        def read(wrapper: str | None) -> Wrapper | None:
            if wrapper and wrapper not in known:
                if len(known) > 256:
                    known.clear()
                known[wrapper] = Wrapper.loaded(wrapper)
            return known[wrapper] if wrapper else None

        for batch in batches:
            texts = []
            for text, host, wrapper, whole in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                root = parse(text or "")
                if sent and host:
                    wrapper, whole = sent.value.get((host, layout(root))), sent.value.get((host, ""))
                texts.append(_extract(root, read(wrapper), read(whole)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(made, schema)

"""Main text of web pages by tag-path ratios.

A page is read once into blocks: runs of text between block-level tags, each with its element and the path of
tags from the root to it (equal paths share one number). Per path the text length and the punctuation are
summed and divided by the number of blocks with that path; both ratios are smoothed along the page with a
Gaussian window and multiplied. Paths with a block over THRESHOLD times the mean are content paths, and they
choose the content node: from the root the way goes down while one child holds SHARE of their text, and up
again while what is added is headings, or mostly text of the same paths in a fair amount, or belongs to the
same article element. The node's blocks are the main text, so short paragraphs and headings inside it stay.

Elements whose tag says that they are menus, footers, asides, scripts or styles never count, as the result is to be
without them; nor do forms, headers and elements of which a whole class, id or role says so (its words begin or end
with a telling one, and none such as "no" or "with" turns it into a remark on the layout). But a name judges only
what it may name: an element that holds the page's article or most of its text is a wrapper and stays, and words that
are also said of parts of an article (WEAK) drop nothing inside one that reads like its text. Words that articles use
of themselves (AMBIGUOUS), and ids inside an article, only keep an element's text from choosing the node; inside the
node it stays.

Pages are independent: a narrow pass, one page at a time in a task, in time and memory that grow in
proportion to the page, whatever its markup: tags are found by one scan (a quote that leaves a tag without an
end makes quotes count no more from there on), open elements by their tag, subtrees by ranges of numbers.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.5
SHARE = 2 / 3
#: Text that joins the node from outside must be so large a part of it.
FAIR = 1 / 8
WINDOW = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2)
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike"
    " strong sub sup time tt u var wbr".split())
#: Elements without text for the reader, and elements that stand beside an article.
NEVER = frozenset(
    "script style noscript template head button select textarea iframe object svg canvas title noembed noframes xmp audio video map".split())
BESIDE = frozenset("nav footer aside dialog menu".split())
#: Words of names of elements that are no part of an article.
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
WORDS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored nav navigation navbar menu menubar breadcrumb breadcrumbs masthead topbar"
    " footer bottombar sidebar aside contentinfo cookie cookies consent gdpr popup overlay subscribe newsletter widget toolbar pager pagination".split())
#: Words that are said of parts of an article as well: inside of one they drop what does not read like its text.
WEAK = frozenset("promo promotion modal share sharing login signup related recommended recommendations complementary".split())
#: Words that may as well name a part of an article.
AMBIGUOUS = frozenset("notice notices notification alert discussion reply replies form search related legal copyright tags skip banner header social".split())
#: Words that turn a name into a remark on the layout.
LAYOUT = frozenset("no not non with without has have hide hidden layout page wrapper container content two three col".split())
#: Elements whose id is often a slug of their own words.
SLUGS = frozenset("h1 h2 h3 h4 h5 h6 section p".split())
#: Part of the page's text that a wrapper holds; length and share of marks of what reads like text.
MOST, SENTENCE, MARKED = 0.6, 40, 1 / 200
PLACES = frozenset(("article", "main"))
#: Opening one of these ends an open paragraph; opening an item ends the open item of its list.
ENDS_ITEM = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OPENING = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][^\s/>]*))")
PLAIN = re.compile(r"[^>\"']*")
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")


NONE, MAY, WEAKLY, SURELY, COMMENT = range(5)


def _named(tag: str, attributes: str, inside: bool) -> int:
    """How far names say that an element is no part of an article."""
    most = NONE
    for name, a, b, c in NAMED.findall(attributes):
        slug = name.lower() == "id" and (inside or tag in SLUGS)
        if tag in HEADINGS or slug and tag not in ("section", "p"):
            continue
        for token in (a or b or c).split():
            parts = [w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", token) if w]
            if not parts or not LAYOUT.isdisjoint(parts):
                continue
            ends = {parts[0], parts[-1]}
            level = COMMENT if ends & COMMENTS else SURELY if ends & WORDS else WEAKLY if ends & WEAK else MAY if ends & AMBIGUOUS else NONE
            most = max(most, min(level, MAY) if slug else level)
    return most


class Element:
    __slots__ = ("tag", "parent", "out", "never", "said", "may", "path", "place", "number", "first", "last")

    def __init__(self, tag: str, parent: Element | None, never: bool, said: int, path: int, number: int, first: int):
        self.tag, self.parent, self.never, self.said, self.path, self.number = tag, parent, never, said, path, number
        self.first = self.last = first
        self.out = False
        self.may = said == MAY or parent is not None and parent.may
        self.place = self if tag in PLACES and said < SURELY else parent.place if parent else None


class Open:
    """The elements of a page, and those that are open. An element holds the blocks from first to last - 1."""

    def __init__(self, found: list):
        self.found = found
        self.paths: dict[tuple[int, str], int] = {}
        self.all: list[Element] = []
        self.stack: list[Element] = []
        self.at: dict[str, list[int]] = {}
        self.push("", False, NONE)

    def push(self, tag: str, never: bool, said: int) -> None:
        top = self.stack[-1] if self.stack else None
        path = self.paths.setdefault((top.path if top else -1, tag), len(self.paths))
        e = Element(tag, top, never, said, path, len(self.all), len(self.found))
        self.at.setdefault(tag, []).append(len(self.stack))
        self.all.append(e)
        self.stack.append(e)

    def cut(self, depth: int) -> None:
        """Close all elements from this depth of the stack on."""
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.at[e.tag].pop()
            e.last = len(self.found)

    def depth(self, *tags: str) -> int:
        """Depth of the innermost open element with one of these tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def blocks(html: str) -> tuple[list[tuple[str, Element]], list[Element]]:
    """Blocks of a page with their innermost block element, and all elements; blocks that do not count are left out."""
    found: list[tuple[str, Element]] = []
    tree = Open(found)
    stack = tree.stack
    inline: list[tuple[str, bool]] = []  # open inline elements, and whether they are to be left out
    names: dict[str, int] = {}
    text: list[str] = []
    hidden, quotes = 0, True

    def flush():
        if text:
            s = " ".join(unescape("".join(text)).split())
            if s and not stack[-1].never:
                found.append((s, stack[-1]))
            text.clear()

    at, end = 0, len(html)
    last, last_quote = html.rfind(">"), {q: html.rfind(q) for q in "\"'"}

    def tag_end(i: int) -> int:
        """Where the tag whose name ends at i ends: the first > that is not in quotes, if quotes leave one."""
        nonlocal quotes
        start = i
        while quotes:
            i = PLAIN.match(html, i).end()
            if i >= end:
                quotes = False
            elif html[i] == ">":
                return i
            else:
                i = html.index(html[i], i + 1) + 1 if last_quote[html[i]] > i else i + 1
        return html.index(">", start)

    while at < end:
        m = OPENING.search(html, at)
        if m and m.start() > last and not m[1]:
            m = None  # no tag ends after this
        stop = m.start() if m else end
        if stop > at and not hidden and not stack[-1].never:
            text.append(html[at:stop])
        if not m:
            break
        at = m.end()
        if m[1]:
            close = html.find("-->", at)
            at = close + 3 if close >= 0 else end
            continue
        if m[2]:
            at = html.index(">", at) + 1
            continue
        close = tag_end(at)
        rest, at = html[at:close], close + 1
        tag, closing = m[4].lower(), bool(m[3])
        if tag == "br":
            text.append(" ")
        elif tag in INLINE:
            if closing:
                if names.get(tag):
                    while True:
                        name, out = inline.pop()
                        names[name] -= 1
                        hidden -= out
                        if name == tag:
                            break
            elif not rest.endswith("/"):
                out = "=" in rest and _named(tag, rest, stack[-1].place is not None) >= SURELY
                hidden += out
                inline.append((tag, out))
                names[tag] = names.get(tag, 0) + 1
        elif tag in VOID:
            if tag == "hr":
                flush()
        else:
            flush()
            inline.clear()
            names.clear()
            hidden = 0
            if closing:
                if depth := tree.depth(tag):
                    tree.cut(depth)
                continue
            if stack[-1].tag == "p" or tag == "body" and stack[-1].tag == "head":
                tree.cut(len(stack) - 1)
            if tag in ENDS_ITEM and (depth := tree.depth(tag)) > tree.depth(*ENDS_ITEM[tag]):
                tree.cut(depth)
            here = stack[-1]
            said = _named(tag, rest, here.place is not None) if tag not in ("html", "body", "main") and "=" in rest else NONE
            tree.push(tag, here.never or tag in NEVER, said)
            if tag in RAW:
                raw = re.compile(f"</{re.escape(tag)}\\b", re.I).search(html, at)
                at = raw.start() if raw else end
    flush()
    tree.cut(0)
    return _judged(found, tree.all)


def _judged(found: list, elements: list[Element]) -> tuple[list, list[Element]]:
    """The blocks that count, their elements' ranges being ranges of these."""
    size = np.concatenate([[0], np.cumsum([len(s) for s, _ in found])]).astype(np.int64)
    places = [0] * len(elements)  # articles and main elements in each element, itself included
    for e in reversed(elements):
        places[e.number] += e.tag in PLACES and e.said < SURELY
        if e.parent:
            places[e.parent.number] += places[e.number]
    for e in elements[1:]:
        text = int(size[e.last] - size[e.first])
        wrapper = places[e.number] > 0 or text > MOST * size[-1]
        if e.said == COMMENT:  # comments may be articles themselves, and have most of the text
            own = text == size[-1] or 0 < places[e.number] == places[0]
        elif e.said == SURELY or e.tag == "form":
            own = wrapper
        elif e.said == WEAKLY:
            marks = sum(len(PUNCTUATION.findall(s)) for s, _ in found[e.first : e.last]) if not wrapper and e.parent.place is not None and text >= SENTENCE else 0
            own = wrapper or marks >= max(1, MARKED * text)
        else:
            own = True
        beside = e.tag in BESIDE or e.tag == "header" and e.place is None and not wrapper
        e.out = e.parent.out or beside or not own
    kept = [not e.out for _, e in found]
    before = np.concatenate([[0], np.cumsum(kept)]).astype(np.int64)
    for e in elements:
        e.first, e.last = int(before[e.first]), int(before[e.last])
    return [x for x, k in zip(found, kept) if k], elements


def _smooth(v: np.ndarray) -> np.ndarray:
    weight = np.convolve(np.ones(len(v)), WINDOW, "same")[: len(v)] if len(v) >= len(WINDOW) else None
    if weight is None:  # fewer blocks than the window has places
        k = np.exp(-0.5 * (np.arange(len(v))[:, None] - np.arange(len(v))[None, :]) ** 2)
        return k @ v / k.sum(axis=1)
    return np.convolve(v, WINDOW, "same") / weight


def content_paths(found: list[tuple[str, Element]]) -> set[int]:
    """Paths whose smoothed and fused ratios of text and punctuation pass the threshold at one of their blocks."""
    path = np.array([e.path for _, e in found])
    size = np.array([len(s) for s, _ in found], np.float64)
    marks = np.array([len(PUNCTUATION.findall(s)) for s, _ in found], np.float64)
    count = np.bincount(path)
    by_text, by_marks = (_smooth((np.bincount(path, v) / np.maximum(count, 1))[path]) for v in (size, marks))
    score = by_text * (1 + by_marks)
    return set(path[score >= THRESHOLD * score.mean()].tolist())


def content_node(found: list[tuple[str, Element]], counted: list[int], elements: list[Element]) -> Element:
    """The element that the content paths of the counted blocks choose."""
    seen = [found[i] for i in counted]
    paths = content_paths(seen)
    mass = [0] * len(elements)
    for s, e in seen:
        if e.path in paths:
            mass[e.number] += len(s)
    heaviest: dict[int, Element] = {}
    for e in reversed(elements[1:]):  # children come after their parents
        up = e.parent.number
        mass[up] += mass[e.number]
        if up not in heaviest or mass[e.number] >= mass[heaviest[up].number]:
            heaviest[up] = e
    best = elements[0]
    while (down := heaviest.get(best.number)) is not None and mass[down.number] and mass[down.number] >= SHARE * mass[best.number]:
        best = down
    lo, hi = bisect_left(counted, best.first), bisect_left(counted, best.last)
    own = {e.path for _, e in seen[lo:hi]} & paths
    while best.parent is not None:
        up = best.parent
        i, j = bisect_left(counted, up.first), bisect_left(counted, up.last)
        added = seen[i:lo] + seen[hi:j]
        same = sum(len(s) for s, e in added if e.path in own)
        other = sum(len(s) for s, e in added if e.path not in own and e.tag not in HEADINGS)
        if (same or other) and not (same >= other and same >= FAIR * mass[best.number]):
            break
        own |= {e.path for _, e in added} & paths
        best, lo, hi = up, i, j
    around = best
    while around is not None and around.tag != "article":
        around = around.parent
    return around or best


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by line ends; empty if the page has no text."""
    found, elements = blocks(html) if html else ([], [])
    if not found:
        return ""
    best = content_node(found, [i for i, (_, e) in enumerate(found) if not e.may] or list(range(len(found))), elements)
    return "\n".join(s for s, _ in found[best.first : best.last])


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text and n_chars, its code points.

    Null and empty pages give empty text; very long pages are read whole, in time in proportion to their length;
    repeated rows are read one by one; an empty table gives no rows.
    Other columns stay, but a column named text or n_chars is replaced.
    """
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]

    def run(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(html_col)]
            yield pa.record_batch(
                [*(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"])

    schema = pages.select(*keep).schema
    return pages.select(*keep, F.col(html_col)).mapInArrow(run, schema.add("text", "string").add("n_chars", "long"))

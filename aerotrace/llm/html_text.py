"""Main text of web pages from the events of the standard library's parser.

The page is fed to the parser in pieces. Its events make blocks, the lines of the method: the text
between two block-level tags, with the number of tags seen in it and the element around it. Each block
has a text-to-tag ratio, characters over tags; blocks inside menus, headers, footers, sidebars, notices,
adverts, forms or reader comments count as having no text. The ratios are smoothed with a Gaussian
over neighbouring blocks and split into two clusters; the blocks of the upper one are the core of the
content. The content region is the smallest element that holds nearly all of the core, or the whole
``article`` or ``main`` around it. Every block of the region counts, short ones too, since only the region is
chosen by ratio. Where that element is the page body itself, the region runs from the first to the last block of the
core.

Tags and roles say for certain what a part is, class names and ids only raise a doubt: many templates put "sidebar" or "share" into
the name of the element around the article. The ratios are first taken without regard to names. A doubted element that holds at least
half of the text of their upper cluster, comments not counted, and a page heading, ``main`` or ``article`` besides, is no side part whatever its name. On a page
without any of those, half of the text is enough, but not for an element named for comments. Any other doubted element counts as a side part.

Edge cases: a NULL or empty page, and one without content, has an empty text; repeated rows are each parsed;
broken markup is read as far as it goes, in time that grows with its length only, however deep it nests; other columns are left out; a long page needs memory
for its text and a few numbers for each of its elements.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from aerotrace.llm.common import slices

FEED = 1 << 16
SIGMA = 1.5
CORE_SHARE = 0.95

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = frozenset("script style head title noscript template nav header footer aside form button select textarea option iframe object svg math canvas audio video dialog menu".split())
WHOLE = frozenset(("article", "main"))
KEPT = frozenset(("html", "body", "article", "main", "b", "i", "em", "strong", "a"))
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
PARTS = frozenset("""ad ads adv advert adverts advertisement advertising adsbygoogle adslot sponsor sponsored sponsors promo promos promotion banner banners popup modal overlay
 cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login paywall comment comments respond reply replies disqus discussion
 sidebar sidebars side widget widgets related recommended recommendations recommend share sharing social menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager
 header masthead topbar footer foot bottombar copyright legal disclaimer skip search toolbar tags taglist""".split())
COMMENTS = frozenset("comment comments respond reply replies disqus discussion".split())
ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


@dataclass(slots=True)
class Block:
    parts: list[str] = field(default_factory=list)
    filled: bool = False
    linked: int = 0
    tags: int = 0
    element: int = 0
    out: bool = False
    text: str = ""


@dataclass(slots=True)
class Element:
    tag: str
    parent: int = 0
    out: bool = False
    doubt: str = ""  # "part" or "comments", from its names
    landmark: bool = False


class Blocks(HTMLParser):
    """Collects the blocks of a page and its elements, numbered in the order of their start tags; number 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements = [Element("")]
        self.open = [0]
        self.open_blocks = [0]  # places in ``open`` of those that are not inline
        self.count: dict[str, int] = {}
        self.blocks: list[Block] = []
        self.now = Block()

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def flush(self) -> None:
        b = self.now
        if b.parts:
            b.text = " ".join("".join(b.parts).split())
            b.parts = []
        if b.text or b.tags:
            self.blocks.append(b)
        self.now = Block()

    def named(self, tag: str, attrs: list[tuple[str, str | None]], parent: int) -> Element:
        """The element of a start tag: out by its tag or role, in doubt by its names. An inline one is out if it is named for a part and nothing else."""
        words, tokens, out = set(), set(), tag in NEVER
        for name, value in attrs:
            if value and name in ("class", "id"):
                words.update(w.lower() for w in WORD.findall(value))
                tokens.update(value.lower().split())
            elif value and name == "role" and tag not in KEPT:
                out = out or value.lower() in ROLES
        part = not words.isdisjoint(PARTS)
        landmark = tag in ("h1", "main") or tag == "article" and not part
        if tag in INLINE:
            return Element(tag, parent, self.elements[parent].out or out or tag not in KEPT and not tokens.isdisjoint(PARTS))
        doubt = "" if tag in KEPT or not part else "part" if words.isdisjoint(COMMENTS) else "comments"
        return Element(tag, parent, self.elements[parent].out or out, doubt, landmark)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        inline = tag in INLINE
        if not inline:
            self.flush()
            if tag not in VOID:
                self.close_implied(tag)
        self.now.tags += 1
        if tag in VOID:
            return
        self.count[tag] = self.count.get(tag, 0) + 1
        if not inline:
            self.open_blocks.append(len(self.open))
        self.elements.append(self.named(tag, attrs, self.open[-1]))
        self.open.append(len(self.elements) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML has no self-closing elements but the void ones

    def close(self, to: int | None = None) -> None:
        """Closes the open elements from place ``to`` on; without it, the parser."""
        if to is None:
            super().close()
            return
        while len(self.open) > to:
            self.count[self.elements[self.open.pop()].tag] -= 1
        while self.open_blocks[-1] >= to:
            self.open_blocks.pop()

    def close_implied(self, tag: str) -> None:
        """A block-level tag ends an open paragraph; an item or cell ends its like."""
        last = self.open_blocks[-1]
        if self.elements[self.open[last]].tag in ("p", *ALIKE.get(tag, ())):
            self.close(last)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self.now.tags += 1
        if self.count.get(tag):
            at = len(self.open) - 1
            while self.elements[self.open[at]].tag != tag:
                at -= 1
            self.close(at)

    def handle_data(self, data: str) -> None:
        b, top = self.now, self.open[-1]
        if not data.isspace():
            out = self.elements[top].out
            if not b.filled:
                b.element, b.out, b.filled = top, out, True
            if out and not b.out:  # an inline part that is no content
                return
            if b.out and not out:
                b.out, b.parts, b.linked, b.element = False, [], 0, top
            if self.count.get("a"):
                b.linked += len(data)
        b.parts.append(data)


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbours; at the ends over those that exist."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    if not len(x):
        return x
    sums, weights = np.convolve(x, kernel), np.convolve(np.ones(len(x)), kernel)
    return sums[reach:reach + len(x)] / weights[reach:reach + len(x)]


def threshold(x: np.ndarray) -> float:
    """Value between the two means of a one-dimensional 2-means split."""
    low, high = float(x.min()), float(x.max())
    for _ in range(32):
        cut = (low + high) / 2
        upper = x > cut
        if not upper.any() or upper.all():
            break
        a, b = float(x[~upper].mean()), float(x[upper].mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2


def upward(values: np.ndarray, parents: list[int]) -> np.ndarray:
    """Sums of the values over each element and all elements in it."""
    out = values.tolist()
    for n in range(len(out) - 1, 0, -1):
        out[parents[n]] += out[n]
    return np.array(out)


def menus(blocks: list[Block], elements: list[Element]) -> set[int]:
    """Lists of three or more items all of whose text is linked, outside ``article`` and ``main``."""
    lists, whole = [0] * len(elements), [False] * len(elements)  # the innermost list around an element, none within an article
    parents = [e.parent for e in elements]
    for n, e in enumerate(elements[1:], 1):
        whole[n] = whole[e.parent] or e.tag in WHOLE
        lists[n] = 0 if whole[n] else n if e.tag in ("ul", "ol") else lists[e.parent]
    sums = np.zeros((3, len(elements)), np.int64)
    for b in blocks:
        if b.text:
            sums[:, b.element] += (1, len(b.text), b.linked)
    at = [upward(row, parents) for row in sums]
    return {n for n in set(lists) - {0} if at[0][n] >= 3 and at[2][n] >= at[1][n]}


def side_parts(blocks: list[Block], elements: list[Element]) -> list[bool]:
    """Which elements are side parts, or lie in one, by their tags, roles and names and by the text they hold."""
    parents, lists = [e.parent for e in elements], menus(blocks, elements)
    side = [False] * len(elements)
    for n, e in enumerate(elements):
        side[n] = e.out or n in lists or n > 0 and side[e.parent]
    if any(e.doubt for e in elements):
        landmarks = upward(np.array([int(e.landmark and not side[n]) for n, e in enumerate(elements)]), parents)
        first = list(side)
        for n, e in enumerate(elements):
            first[n] = first[n] or n > 0 and first[e.parent] or e.doubt == "comments" and not landmarks[n]
        held = np.zeros(len(elements), np.int64)
        for i in upper(blocks, first):
            held[blocks[i].element] += len(blocks[i].text)
        held = upward(held, parents)
        for n, e in enumerate(elements):
            lifted = held[n] > 0 and held[n] * 2 >= held[0] and (landmarks[n] or not landmarks[0] and e.doubt == "part")
            side[n] = side[n] or n > 0 and side[e.parent] or bool(e.doubt) and not lifted
    return side


def upper(blocks: list[Block], side: list[bool]) -> list[int]:
    """The blocks with text, outside side parts, whose smoothed ratio is in the upper cluster; all with text if none is."""
    bare = [b.out or side[b.element] for b in blocks]
    good = [i for i, b in enumerate(blocks) if b.text and not bare[i]]
    if not good:
        return []
    level = smooth(np.array([0.0 if o else len(b.text) / max(1, b.tags) for b, o in zip(blocks, bare, strict=True)]))
    cut = threshold(level)
    return [i for i in good if level[i] >= cut] or good


def content(blocks: list[Block], elements: list[Element]) -> list[str]:
    """Texts of the blocks of the content region, in page order."""
    side = side_parts(blocks, elements)
    core = upper(blocks, side)
    if not core:
        return []
    held, last = np.zeros(len(elements), np.int64), list(range(len(elements)))
    for i in core:
        held[blocks[i].element] += len(blocks[i].text)
    held = upward(held, [e.parent for e in elements])
    path, n = [], blocks[max(core, key=lambda i: len(blocks[i].text))].element
    while n:
        path.append(n)
        n = elements[n].parent
    total, region = held[0], 0
    for n in reversed(path):
        tag = elements[n].tag
        if held[n] >= CORE_SHARE * total and tag not in INLINE and tag != "p":
            region = n
            if tag in WHOLE:
                break
        elif tag in WHOLE and held[n] * 2 > total:
            region = n
            break
    good = [i for i, b in enumerate(blocks) if b.text and not b.out and not side[b.element]]
    if elements[region].tag in ("", "html", "body"):
        return [blocks[i].text for i in good if core[0] <= i <= core[-1]]
    for n in range(len(elements) - 1, 0, -1):  # an element and all in it are numbered without gaps
        last[elements[n].parent] = max(last[elements[n].parent], last[n])
    return [blocks[i].text for i in good if region <= blocks[i].element <= last[region]]


def main_text(html: str | None) -> str:
    """The page's main text; empty for None or a page without one."""
    if not html:
        return ""
    parser = Blocks()
    for at in range(0, len(html), FEED):
        parser.feed(html[at:at + FEED])
    parser.close()
    parser.flush()
    return " ".join(content(parser.blocks, parser.elements))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                texts = [main_text(h) for h in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
